"""Fair classification by reductions: a saddle point between weighted fits and multipliers on group constraints."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tabular import materialize
from .learners import with_features


def linear_program(cost: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The x >= 0 of least ``cost`` with a x = b, by the simplex method in two phases (Bland's rule)."""
    sign = np.where(b < 0, -1.0, 1.0)
    a, b = a * sign[:, None], b * sign
    m, n = a.shape
    table = np.hstack([a, np.eye(m), b[:, None]])
    basis = list(range(n, n + m))

    def solve(c: np.ndarray, width: int) -> None:
        for _ in range(10_000):
            reduced = c[:width] - c[basis] @ table[:, :width]
            enter = next((j for j in range(width) if reduced[j] < -1e-11), None)
            if enter is None:
                return
            column = table[:, enter]
            rows = [i for i in range(m) if column[i] > 1e-11]
            if not rows:
                raise ValueError("the program has no bound")
            least = min(table[i, -1] / column[i] for i in rows)
            leave = min((i for i in rows if table[i, -1] / column[i] <= least + 1e-13), key=lambda i: basis[i])
            table[leave] /= table[leave, enter]
            for i in range(m):
                if i != leave:
                    table[i] -= table[i, enter] * table[leave]
            basis[leave] = enter
        raise RuntimeError("the program did not settle")

    solve(np.append(np.zeros(n), np.ones(m)), n + m)
    if sum(table[i, -1] for i in range(m) if basis[i] >= n) > 1e-9:
        raise ValueError("the program has no solution")
    for i in range(m):  # what is left of the first phase leaves the basis
        if basis[i] >= n:
            j = next((j for j in range(n) if abs(table[i, j]) > 1e-9), None)
            if j is not None:
                table[i] /= table[i, j]
                for k in range(m):
                    if k != i:
                        table[k] -= table[k, j] * table[i]
                basis[i] = j
    solve(np.append(np.asarray(cost, float), np.zeros(m)), n)
    x = np.zeros(n + m)
    x[basis] = table[:, -1]
    return x[:n]


@dataclass
class Mixture:
    """Linear deciders with their weights; ``gap`` and ``violation`` of each round, and the cells they were held to."""

    mean: np.ndarray
    sd: np.ndarray
    deciders: list[np.ndarray] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    gaps: list[float] = field(default_factory=list)
    violations: list[float] = field(default_factory=list)

    def decision(self, cols: list[str]) -> Column:
        """The probability of a positive decision."""
        x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols]
        out = F.lit(0.0)
        for b, w in zip(self.deciders, self.weights, strict=True):
            if w > 0:
                out = out + F.lit(float(w)) * (_margin(x, b, self.mean, self.sd) > 0).cast("double")
        return out


def _margin(x: list[Column], b: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> Column:
    out = F.lit(float(b[-1]))
    for c, v, m, s in zip(x, b[:-1], mean, sd, strict=True):
        if s > 0:
            out = out + F.lit(float(v / s)) * (c - F.lit(float(m)))
    return out


class ExponentiatedGradient:
    """Least error subject to group constraints, as a zero-sum game.

    ``constraint`` "eo": each group's rate of positive decisions given the outcome differs from that of all by
    ``eps`` at most, for either outcome; "dp": the same without regard to the outcome.  A round answers the
    multipliers (an exponential of the summed violations, of total ``bound`` at most) with a fit to rows weighted
    by what a positive decision gains, and the game's value is bracketed by the best answer to the mean
    multipliers and by the best multipliers against the mean decider; or, better, against the mixture of all
    deciders so far that a linear program finds.  The search stops when the bracket is under ``gap``.

    The two constant decisions are deciders too, so that a mixture within ``eps`` always exists.  Rows of a
    null group or outcome take no part in the fit.  What reaches the driver is a count per group, outcome and
    decision.
    """

    def __init__(self, fit: DataFrame, cols: list[str], y: str, attr: str, constraint: str = "eo", eps: float = 0.01, rounds: int = 20, eta: float = 2.0, gap: float = 0.005):
        if constraint not in ("eo", "dp"):
            raise ValueError(f"no constraint {constraint}")
        self.cols, self.eps, self.bound, self.eo = cols, eps, 1 / eps, constraint == "eo"
        fit = fit.filter(F.col(attr).isNotNull() & F.col(y).isNotNull()).select(*cols, F.col(y).cast("int").alias("y"), F.col(attr).cast("string").alias("a"))
        self.fit = materialize(fit, "reductions")
        stats = self.fit.agg(*[F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for c in cols], *[F.stddev_samp(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for c in cols]).first()
        values = np.array([v or 0.0 for v in stats], float)
        self.mix = Mixture(values[: len(cols)], values[len(cols) :])
        self.rows = materialize(with_features(self.fit, self.fit, cols, "y")[0].select("features", "y", "a"), "reductions")
        self.count = {(r.a, r.y): r.n for r in self.fit.groupBy("a", "y").agg(F.count("*").alias("n")).collect()}  # groups x outcomes
        self.groups = sorted({a for a, _ in self.count})
        if any((a, v) not in self.count for a in self.groups for v in (0, 1)):
            raise ValueError("each group needs both outcomes")
        self.n = sum(self.count.values())
        self.events = (0, 1) if self.eo else (None,)
        self.keys = [(a, e) for e in self.events for a in self.groups]
        k = len(self.cols)
        self.tried: list[tuple[float, np.ndarray]] = []
        for constant in (-1.0, 1.0):
            self._add(np.append(np.zeros(k), constant), {key: (n if constant > 0 else 0) for key, n in self.count.items()})
        self._play(rounds, eta, gap)

    def _size(self, a: str | None, e: int | None) -> int:
        return sum(n for (g, v), n in self.count.items() if a in (None, g) and e in (None, v))

    def _add(self, b: np.ndarray, yes: dict) -> int:
        """Keeps a decider with its error and its signed differences of rates."""
        rate = lambda a, e: sum(n for (g, v), n in yes.items() if a in (None, g) and e in (None, v)) / self._size(a, e)
        wrong = sum(yes[key] if key[1] == 0 else n - yes[key] for key, n in self.count.items()) / self.n
        diff = np.array([rate(a, e) - rate(None, e) for a, e in self.keys])
        self.mix.deciders.append(b)
        self.tried.append((wrong, np.concatenate([diff, -diff])))
        return len(self.tried) - 1

    def _answer(self, multipliers: np.ndarray) -> int:
        """The decider fitted to the costs under the multipliers."""
        signed = dict(zip(self.keys, multipliers[: len(self.keys)] - multipliers[len(self.keys) :], strict=True))
        worth = {}
        for a, v in self.count:
            e = v if self.eo else None
            own, every = signed[a, e] / self._size(a, e), sum(signed[g, e] for g in self.groups) / self._size(None, e)
            worth[a, v] = float((1 if v else -1) - self.n * (own - every))
        if len({w > 0 for w in worth.values()}) == 1:  # one decision is best for all
            return int(max(worth.values()) > 0)
        gain = F.lit(0.0)
        for (a, v), w in worth.items():
            gain = F.when((F.col("a") == a) & (F.col("y") == v), F.lit(w)).otherwise(gain)
        rows = self.rows.withColumns({"weight": F.abs(gain), "label": (gain > 0).cast("double")})
        model = LogisticRegression(weightCol="weight", maxIter=25, regParam=1e-4, standardization=False).fit(rows)
        b = np.append(model.coefficients.toArray(), model.intercept)
        x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.cols]
        yes = self.fit.groupBy("a", "y").agg(F.count_if(_margin(x, b, self.mix.mean, self.mix.sd) > 0).alias("n"))
        return self._add(b, {(r.a, r.y): r.n for r in yes.collect()})

    def _value(self, error: float, diff: np.ndarray, multipliers: np.ndarray) -> float:
        return error + float(multipliers @ (diff - self.eps))

    def _gap(self, error: float, diff: np.ndarray, multipliers: np.ndarray, answer: int) -> float:
        now = self._value(error, diff, multipliers)
        high = error + self.bound * max(0.0, float(diff.max()) - self.eps)
        low = min(self._value(*self.tried[i], multipliers) for i in {answer, *range(len(self.tried))})
        return max(high - now, now - low)

    def _program(self) -> np.ndarray:
        """The mixture of the deciders of least error within ``eps``."""
        t, k = len(self.tried), len(self.tried[0][1])
        table = np.zeros((k + 1, t + k))
        table[:k, :t] = np.stack([d for _, d in self.tried], 1)
        table[:k, t:] = np.eye(k)
        table[k, :t] = 1
        cost = np.append([e for e, _ in self.tried], np.zeros(k))
        x = np.maximum(linear_program(cost, table, np.append(np.full(k, self.eps), 1.0))[:t], 0)
        return x / x.sum()

    def _play(self, rounds: int, eta: float, gap: float) -> None:
        theta, total, picked = np.zeros(2 * len(self.keys)), np.zeros(2 * len(self.keys)), np.zeros(0)
        for i in range(rounds):
            grown = np.exp(theta - max(0.0, theta.max()))
            multipliers = self.bound * grown / (np.exp(-max(0.0, theta.max())) + grown.sum())
            answer = self._answer(multipliers)
            picked = np.append(picked, answer).astype(int)
            total = total + multipliers
            mean = total / (i + 1)
            against = self._answer(mean) if i else answer
            average = np.bincount(picked, minlength=len(self.tried)) / (i + 1)
            program = self._program()
            sides = []
            for q in (average, program):
                q = np.append(q, np.zeros(len(self.tried) - len(q)))
                error, diff = float(q @ [e for e, _ in self.tried]), q @ np.stack([d for _, d in self.tried])
                sides.append((self._gap(error, diff, mean, against), float(diff.max()), q))
            self.mix.weights = program
            self.mix.gaps.append(min(sides[0][0], sides[1][0]))
            self.mix.violations.append(sides[1][1])
            if self.mix.gaps[-1] <= gap:
                break
            theta = theta + eta / np.sqrt(i + 1) * (self.tried[answer][1] - self.eps)
        self.mix.weights = np.append(self.mix.weights, np.zeros(len(self.tried) - len(self.mix.weights)))


def exp_gradient(df: DataFrame, fit: DataFrame, cols: list[str], y: str, attr: str, **options) -> DataFrame:
    """``df`` with ``q_decision``, the probability of a positive decision under the mixture fitted on ``fit``."""
    return df.withColumn("q_decision", ExponentiatedGradient(fit, cols, y, attr, **options).mix.decision(cols))
