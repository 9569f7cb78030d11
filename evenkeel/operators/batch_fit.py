"""Logistic fits of many candidate states in one scan a step.

Rows become one array of columns that holds what any candidate needs, each block of columns once.  A Newton
step of all candidates is one job: tasks sum losses, gradients and Hessians of their rows by candidate, and what
reaches the driver is these sums, whose size is set by the registered columns.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import unpivot
from ..sources.package import ship
from ..sources.tabular import materialize
from . import ranking as R
from .transforms import power


class Design:
    """``x`` (array) of every block that the states need, and the places of each state's columns in it.

    ``states`` are {name: {feature: "dropped" | {"power": p} | {"merge": {old: new}}}}.  A numeric feature is one
    column, null as 0; a categorical one has a column for each level it has after the merge, for a missing and
    for an unknown value, levels being those of the training rows.  More than ``most`` columns are an error.
    """

    def __init__(self, parts: DataFrame, states: dict, cats: list[str], nums: list[str], keep: list[str], most: int = 1000):
        known: dict[str, list[str]] = {c: [] for c in cats}
        if cats:
            train = parts.filter("split = 'train'")
            found = unpivot(train, cats, "feature", "level", []).filter("level is not null").distinct().limit(most + 1).collect()
            if len(found) > most:
                raise ValueError(f"more than {most} levels")
            for r in found:
                known[r.feature].append(r.level)
        self.columns: dict[object, list[int]] = {}
        self.blocks: dict[object, dict[str, list[int]]] = {}
        blocks: dict[tuple[str, str], list[int]] = {}
        cols: list[Column] = []
        for name, state in states.items():
            own: dict[str, list[int]] = {}
            for f in [*nums, *cats]:
                change = state.get(f, {})
                at = (f, json.dumps(change, sort_keys=True))
                if at not in blocks:
                    new = _block(f, change, known.get(f))
                    blocks[at] = list(range(len(cols), len(cols) + len(new)))
                    cols += new
                own[f] = blocks[at]
            self.blocks[name] = own
            self.columns[name] = [i for b in own.values() for i in b]
        if len(cols) > most:
            raise ValueError(f"more than {most} columns")
        x = F.array(*cols) if cols else F.array().cast("array<double>")
        self.rows = materialize(parts.select(*keep, x.alias("x")), "design")
        self.width = len(cols)


def _block(feature: str, change, known: list[str] | None) -> list[Column]:
    if change == "dropped":
        return []
    if known is None:
        x = F.col(feature).cast("double")
        return [F.coalesce(power(x, float(change["power"])) if "power" in change else x, F.lit(0.0))]
    merge = change.get("merge", {})
    x = F.col(feature).cast("string")
    levels: dict[str, list[str]] = {}
    for old in sorted(known):
        levels.setdefault(merge.get(old, old), []).append(old)
    hits = [x.isin(old) for old in levels.values()]
    return [F.coalesce(h, F.lit(False)).cast("double") for h in [*hits, x.isNull(), ~x.isin(known) if known else x.isNotNull()]]


def _matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy().reshape(batch.num_rows, width)


def _scaled(x: np.ndarray, cols: list[int], mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """The state's columns in units of their deviation, constant ones as 0, and a 1 for the intercept."""
    scale = sd[cols]
    z = np.where(scale > 0, (x[:, cols] - mean[cols]) / np.where(scale > 0, scale, 1), 0)
    return np.column_stack([z, np.ones(len(x))])


def _at_rest(b: np.ndarray, gradient: np.ndarray, lasso: float) -> float:
    """How far the optimality conditions are from being met."""
    if not lasso:
        return float(np.abs(gradient).max())
    off = np.where(b != 0, np.abs(gradient + lasso * np.sign(b)), np.maximum(np.abs(gradient) - lasso, 0))
    off[-1] = abs(gradient[-1])
    return float(off.max())


def _lasso_step(b: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, lasso: float, rounds: int = 10_000) -> np.ndarray:
    """The least of the quadratic model plus the absolute coefficients, coordinate by coordinate."""
    x, penalty = b.copy(), np.append(np.full(len(b) - 1, lasso), 0.0)
    slope = gradient.copy()  # of the model at x
    for _ in range(rounds):
        far = 0.0
        for j in range(len(b)):
            h = hessian[j, j]
            if h <= 1e-12 and not slope[j]:
                continue
            u = x[j] - slope[j] / h
            new = np.sign(u) * max(abs(u) - penalty[j] / h, 0.0)
            if new != x[j]:
                slope = slope + hessian[:, j] * (new - x[j])
                far = max(far, abs(new - x[j]))
                x[j] = new
        if far < 1e-13:
            break
    return x


class BatchFit:
    """Logistic fits with an L2 penalty of ``reg`` / 2 on coefficients of standardised columns (none on the
    intercept), of the mean loss weighted by ``weight``; ``fits[name]`` holds the coefficients, the intercept last.

    Newton steps from 0; a step that does not lower the loss is halved.  A fit is done when its gradient is under
    ``tolerance``.  A training set of one class has no fit (``fits[name]`` is None).

    ``l1`` {name: penalty} adds the absolute coefficients; a step is then that of the penalised quadratic model.
    ``hold`` {name: fold} leaves rows of that value of the column ``fold`` out of a fit.
    """

    def __init__(
        self, design: Design, y: str, weight: str | None = None, reg: float = 1e-3, rounds: int = 60, tolerance: float = 1e-9,
        l1: dict | None = None, hold: dict | None = None, fold: str | None = None,
    ):
        self.design, self.y = design, y
        l1, hold = l1 or {}, hold or {}
        width = design.width
        w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
        train = design.rows.filter("split = 'train'").select("x", F.col(y).cast("double").alias("y"), w.alias("w"), (F.col(fold) if fold else F.lit(-1)).cast("int").alias("fold"))
        each = [F.get("x", F.lit(i)) for i in range(width)]
        total, pos, *stats = train.agg(F.sum("w"), F.sum(F.col("w") * F.col("y")), *[F.avg(c) for c in each], *[F.stddev_samp(c) for c in each]).first()
        self.mean, self.sd = (np.array([v or 0.0 for v in part], float) for part in (stats[:width], stats[width:]))
        names = list(design.columns)
        self.fits: dict = dict.fromkeys(names)
        self.steps = 0
        if not total or not 0 < pos < total:
            return
        sizes = [len(design.columns[n]) + 1 for n in names]
        beta = [np.zeros(d) for d in sizes]
        before: list[tuple[float, np.ndarray] | None] = [None] * len(names)
        self.train = train
        todo = list(range(len(names)))
        ship(train.sparkSession)
        while todo and self.steps < rounds:
            self.steps += 1
            sums = self._sums([(i, design.columns[names[i]], beta[i], hold.get(names[i], -2)) for i in todo])
            still = []
            for i in todo:
                d, b, total = sizes[i], beta[i], sums[i][-1]
                ridge, lasso = np.append(np.full(d - 1, reg), 0.0), l1.get(names[i], 0.0)
                if not total:
                    continue
                loss = sums[i][0] / total + (ridge * b * b).sum() / 2 + lasso * np.abs(b[:-1]).sum()
                if before[i] is not None and loss > before[i][0] + 1e-14 * abs(before[i][0]) and np.abs(b - before[i][1]).max() > 1e-12:
                    beta[i] = (b + before[i][1]) / 2
                    still.append(i)
                    continue
                gradient = sums[i][1 : d + 1] / total + ridge * b
                if _at_rest(b, gradient, lasso) < tolerance:
                    self.fits[names[i]] = b
                    continue
                hessian = np.zeros((d, d))
                hessian[np.triu_indices(d)] = sums[i][d + 1 : -1] / total
                hessian = hessian + np.triu(hessian, 1).T + np.diag(ridge + 1e-12)
                before[i] = (loss, b)
                beta[i] = _lasso_step(b, gradient, hessian, lasso) if lasso else b - np.linalg.solve(hessian, gradient)
                still.append(i)
            todo = still
        for i in todo:  # as near as the rounds went
            self.fits[names[i]] = beta[i]

    def _sums(self, asked: list[tuple[int, list[int], np.ndarray, int]]) -> dict[int, np.ndarray]:
        """Loss, gradient, upper triangle of the Hessian and weight of each candidate, summed over its training rows."""
        mean, sd, width = self.mean, self.sd, self.design.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for b in batches:
                if not b.num_rows:
                    continue
                x, y, every, fold = _matrix(b, "x", width), *(b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
                for i, cols, beta, out in asked:
                    z = _scaled(x, cols, mean, sd)
                    w = every * (fold != out)
                    t = z @ beta
                    p = 1 / (1 + np.exp(-t))
                    loss = (w * (np.logaddexp(0, t) - y * t)).sum()
                    hessian = z.T @ (z * (w * p * (1 - p))[:, None])
                    got = np.concatenate([[loss], z.T @ (w * (p - y)), hessian[np.triu_indices(len(beta))], [w.sum()]])
                    held[i] = held[i] + got if i in held else got
            for i, v in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([v.tolist()], pa.list_(pa.float64()))], ["i", "v"])

        parts = self.train.mapInArrow(run, "i int, v array<double>").select("i", F.posexplode("v").alias("k", "v"))
        found = parts.groupBy("i", "k").agg(F.sum("v").alias("v"))
        out = {i: np.zeros(2 + len(b) + len(b) * (len(b) + 1) // 2) for i, _, b, _ in asked}
        for r in found.collect():  # registered columns only
            out[r.i][r.k] = r.v
        return out

    def scores(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """(keep, p_<name> for each state that has a fit): each row once."""
        mean, sd, width = self.mean, self.sd, self.design.width
        asked = [(f"p_{n}", self.design.columns[n], b) for n, b in self.fits.items() if b is not None]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _matrix(b, "x", width) if b.num_rows else np.zeros((0, width))
                p = [pa.array(1 / (1 + np.exp(-(_scaled(x, cols, mean, sd) @ beta)))) for _, cols, beta in asked]
                yield pa.RecordBatch.from_arrays([*b.columns[1:], *p], [*keep, *[n for n, *_ in asked]])

        ship(rows.sparkSession)
        kinds = ", ".join([f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep] + [f"{n} double" for n, *_ in asked])
        return rows.select("x", *keep).mapInArrow(run, kinds)

    def score(self, rows: DataFrame, keep: list[str], name: str = "candidate") -> DataFrame:
        """(``name``, keep, p_event): each row once for each state that has a fit, in one pass."""
        mean, sd, width = self.mean, self.sd, self.design.width
        asked = [(str(n), self.design.columns[n], b) for n, b in self.fits.items() if b is not None]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _matrix(b, "x", width) if b.num_rows else np.zeros((0, width))
                for n, cols, beta in asked:
                    p = 1 / (1 + np.exp(-(_scaled(x, cols, mean, sd) @ beta)))
                    yield pa.RecordBatch.from_arrays([pa.array([n] * b.num_rows, pa.string()), *b.columns[1:], pa.array(p)], [name, *keep, "p_event"])

        ship(rows.sparkSession)
        kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
        return rows.select("x", *keep).mapInArrow(run, f"{name} string, {kinds}, p_event double")


def utilities(
    parts: DataFrame, states: dict[str, dict], cats: list[str], nums: list[str], keep: list[str], y: str, on: str = "val", metric: str = "ba", weight: str | None = None
) -> dict[str, tuple[float | None, str]]:
    """(utility, status) of each state: fitted on the training rows, measured on those of split ``on``.

    ``metric`` "ba" is balanced accuracy at the state's own best threshold there, "auroc" the area under its
    curve.  A split of one class, or without rows, has no utility (SINGLE_CLASS).
    """
    design = Design(parts, states, cats, nums, keep)
    fit = BatchFit(design, y, weight)
    rows = design.rows.filter(F.col("split") == on)
    out: dict[str, tuple[float | None, str]] = dict.fromkeys(states, (None, "SINGLE_CLASS"))
    if all(b is None for b in fit.fits.values()):
        return out
    scored = materialize(fit.score(rows, [y]), "scored")
    found = R.threshold_search_ba(scored, ["candidate"], y, "p_event") if metric == "ba" else R.auroc(scored, ["candidate"], y, "p_event")
    for r in found.collect():
        if r[metric] is not None:
            out[r.candidate] = (r[metric], "VALID")
    return out
