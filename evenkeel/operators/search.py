"""Searches: drivers over sufficient statistics, never over rows.

A search step works on the cell table (category counts) and on moments; rows are scanned once for the
statistics of all candidates, and once more to apply the accepted state.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..sources.tabular import materialize
from . import geometry as G
from . import prep as P
from .transforms import FLOAT32_MAX, power, rebin_r1

#: The least normalised information, which a dropped feature has.
LEAST_NMI = 1e-6


def info_loss_gate(before: DataFrame, after: DataFrame, phi: float) -> DataFrame:
    """(feature, nmi_before, nmi_after, accepted): the relative loss of information is ``phi`` at most."""
    both = before.withColumnRenamed("nmi", "nmi_before").join(after.withColumnRenamed("nmi", "nmi_after"), "feature")
    loss = ratio(F.col("nmi_before") - F.col("nmi_after"), F.col("nmi_before"))
    return both.withColumn("accepted", loss <= phi)


def adaptive_phi(phi: float, before: float, after: float, progress: float = 0.10, cut: float = 0.05) -> float:
    """``phi`` lowered by ``cut`` when the relative progress is under ``progress``."""
    return phi * (1 - cut) if before <= 0 or (before - after) / before < progress else phi


def merge_cells(cell: DataFrame, feature: str, mapping: dict[str, str]) -> DataFrame:
    """The cell table after a merge: sums of cells, no row is read again."""
    c = F.col("category")
    for old, new in mapping.items():
        c = F.when((F.col("feature") == feature) & (F.col("category") == old), F.lit(new)).otherwise(c)
    keys = [k for k in cell.columns if k not in ("n", "sw", "category")]
    return cell.withColumn("category", c).groupBy(*keys, "category").agg(F.sum("n").alias("n"), F.sum("sw").alias("sw"))


def compose(old: dict[str, str], src: str, dst: str) -> dict[str, str]:
    """The mapping ``old``, then ``src`` into ``dst``."""
    return {k: dst if v == src else v for k, v in old.items()} | {src: dst}


def merge_chain(cell: DataFrame, feature: str, attr: str, start: dict[str, str] | None = None) -> list[tuple[dict[str, str], int]]:
    """(mapping, categories left) after each merge of the pair of the widest share gap, down to one category.

    Goes on from the mapping ``start``.  ``cell`` holds a row per attribute, group, feature and category, so
    what a round reads is bounded by the registry.
    """
    mapping = dict(start or {})
    own = merge_cells(cell.filter((F.col("feature") == feature) & (F.col("attr") == attr)), feature, mapping)
    out: list[tuple[dict[str, str], int]] = []
    left = own.select("category").distinct().count()
    while left > 1:
        own = materialize(own, "cells")
        best = rebin_r1(own, 1).orderBy(F.desc("gap"), "grp_a", "grp_b").first()
        if best is None:
            break
        mapping, left = compose(mapping, best.src, best.dst), left - 1
        own = merge_cells(own, feature, {best.src: best.dst})
        out.append((mapping, left))
    return out


def power_moments(df: DataFrame, attrs: list[str], feature: str, powers: list[float], w: str | None = None) -> DataFrame:
    """(attr, grp, feature) moments of every candidate power in one scan; ``feature`` is the power's place in the list."""
    names = [f"_p{i}" for i in range(len(powers))]
    x = F.col(feature).cast("double")
    got = G.moments(df.select(*attrs, *([w] if w else []), *[power(x, float(p)).alias(n) for n, p in zip(names, powers, strict=True)]), attrs, names, w)
    return got.withColumn("feature", F.substring("feature", 3, 9))


def search_numerical(df: DataFrame, attrs: list[str], feature: str, powers: list[float], epsilon: float) -> DataFrame:
    """(power, g, accepted): the worst divergence at each power; the first in stream order under ``epsilon`` is accepted."""
    g = G.div_num(power_moments(df, attrs, feature, powers)).groupBy("feature").agg(F.max("g").alias("g"))
    order = df.sparkSession.createDataFrame([(i, str(i), float(p)) for i, p in enumerate(powers)], "i int, feature string, power double")
    out = order.join(g, "feature")
    first = out.agg(F.min(F.when(F.col("g") < epsilon, F.col("i"))).alias("first"))
    return out.crossJoin(F.broadcast(first)).select("i", "power", "g", F.coalesce(F.col("i") == F.col("first"), F.lit(False)).alias("accepted"))  # one row


def origin_distances(g: dict[str, list[tuple]], only: str | None = None) -> dict[tuple[str, str], float]:
    """Distance to the origin by (attr, feature), of divergences {feature: [(attr, group, group, g)]}; of one feature, or all.

    The closed form of ``geometry.distances`` on one state's table, which has a row per group pair and feature.
    """
    square: dict[str, dict[tuple, dict[str, float]]] = {}
    for f, rows in g.items():
        for attr, a, b, v in rows:
            square.setdefault(attr, {}).setdefault((a, b), {})[f] = v * v

    def root(v: float, n: int) -> float:
        return math.sqrt(max(v, 0.0) / n) if n > 0 else 0.0

    out = {}
    for attr, pairs in square.items():
        gaps: dict[str, dict[str, list[float]]] = {}
        for s in pairs.values():
            total, p = sum(s.values()), len(s)
            for f, own in [(only, s[only])] if only in s else s.items() if only is None else []:
                for left, x, k in [("", 0.0, 0), *((o, v, 1) for o, v in s.items() if o != f)]:
                    gap = abs(root(total - x, p - k) - root(total - own - x, p - 1 - k))
                    gaps.setdefault(f, {}).setdefault(left, []).append(gap)
        for f, by in gaps.items():
            out[attr, f] = sum(sum(v) / len(v) for v in by.values()) / len(by)
    return out


class Mitigation:
    """Greedy search of a state {feature: "dropped" | {"power": p} | {"merge": {old: new}}} on statistics of ``df``.

    Each step takes the feature of the largest distance to the origin, over all attributes, and looks for
    the first change of it, in order, that is valid, brings its distance for that attribute under
    ``epsilon``, and loses a share ``phi`` of its information on ``y`` at most.  Categorical features are
    merged pair by pair, and the last merge drops them; numeric ones go through ``powers``, and a power
    that leaves the 32-bit float range means a drop.  A drop loses all information; powers are one to one
    and lose none.  All candidates of a search are measured in one job (powers ``batch`` at a time).

    The distance is that to the origin (``measure`` "origin") or of the embedded points ("dphi").
    ``epsilon`` is, unless given, ``share`` of the mean distance at the start.  A feature without an
    acceptable change ends the search (``mode`` "stop") or is left and the next one taken ("next").  With
    ``cursor`` "monotone" a power that was tried is not tried again for the feature; with "restart" each
    search begins with the first, and a state seen before ends the search.

    ``status`` is CONVERGED (all under epsilon), EXHAUSTED, or CYCLE; ``trace`` holds (step, attr, feature,
    kind, change as JSON, before, after, status), failures too; ``states`` the state at the start and after each
    accepted step.  With ``weight`` shares, means and information are those of the weights, and rows without a
    positive one do not count; a group without a positive total, or a weight that is negative or not finite, is
    an error.  Tables here have a row per attribute, group
    pair and feature or category: bounded by the registry.
    """

    def __init__(
        self, df: DataFrame, attrs: list[str], cats: list[str], nums: list[str], y: str, powers: list[float], *, epsilon: float | None = None,
        share: float = 0.8, phi: float = 0.5, mode: str = "stop", cursor: str = "monotone", measure: str = "origin", batch: int = 4, weight: str | None = None,
    ):
        if mode not in ("stop", "next") or cursor not in ("monotone", "restart") or measure not in ("origin", "dphi"):
            raise ValueError("unknown mode, cursor or measure")
        self.df, self.spark, self.attrs, self.cats, self.y = df, df.sparkSession, attrs, cats, y
        self.powers, self.phi, self.mode, self.cursor, self.measure, self.batch = powers, phi, mode, cursor, measure, batch
        self.weight, self.count = weight, "sw" if weight else "n"
        for a in attrs if weight else []:
            if odd := G.weights_validate(df.filter(F.col(a).isNotNull()), a, weight).filter("status <> 'PASS'").limit(3).collect():
                raise ValueError(f"weights of {a} {[r[a] for r in odd]} cannot be used")
        self.state: dict = {}
        self.states: list[dict] = [{}]
        self.trace: list[tuple] = []
        self.at: dict[str, int] = {}
        self.status = ""
        self.nmi: dict[str, float] = {}
        self.levels: dict[str, list[str]] = {}
        g = None
        if cats:
            self.cell = materialize(G.cells(df, [*attrs, y], cats, weight), "cells")
            self.nmi = {r.feature: r.nmi for r in P.nmi(self._on_y(self.cell), ["feature"], y="grp", n=self.count).collect()}
            for r in self.cell.select("feature", "category").distinct().orderBy("feature", "category").collect():
                self.levels.setdefault(r.feature, []).append(r.category)
            g = G.div_cat(self._on_attrs(self.cell))
        if nums:
            moment = materialize(G.moments(df, attrs, nums, weight), "moments")
            self.largest = {r.feature: r.m for r in moment.groupBy("feature").agg(F.max(F.greatest(F.abs("lo"), F.abs("hi"))).alias("m")).collect()}
            more = G.div_num(moment)
            g = more if g is None else g.unionByName(more)
        self.g: dict[str, list[tuple]] = {}
        for r in g.collect():
            self.g.setdefault(r.feature, []).append((r.attr, r.grp_a, r.grp_b, float(r.g)))
        ranked = self.ranking()
        self.epsilon = share * sum(d for d, *_ in ranked) / len(ranked) if epsilon is None else epsilon

    def _on_y(self, cell: DataFrame) -> DataFrame:
        return cell.filter(F.col("attr") == self.y)

    def _on_attrs(self, cell: DataFrame) -> DataFrame:
        return cell.filter(F.col("attr").isin(self.attrs))

    def distances(self, states: dict[int, dict[str, list[tuple]]], only: str | None = None) -> list[tuple[int, str, str, float]]:
        """(candidate, attr, feature, distance) of the divergences of each candidate state, in one batch."""
        if self.measure == "origin":
            return [(i, attr, f, d) for i, g in states.items() for (attr, f), d in origin_distances(g, only).items()]
        rows = [(i, a, x, y, f, v) for i, g in states.items() for f, pairs in g.items() for a, x, y, v in pairs]
        g = self.spark.createDataFrame(rows, "cand int, attr string, grp_a string, grp_b string, feature string, g double")
        points = G.embed(G.distances(g, ["cand", "attr"]), ["cand", "attr"])
        return [tuple(r) for r in points.select("cand", "attr", "feature", "dphi").collect()]

    def ranking(self) -> list[tuple[float, str, str]]:
        """(distance, attr, feature), the largest first."""
        if not self.g:
            return []
        found = [(d, attr, f) for _, attr, f, d in self.distances({0: self.g})]
        return sorted(found, key=lambda r: (-round(r[0], 12), r[1], r[2]))

    def divergences(self, feature: str, changes: list) -> tuple[list[list[tuple]], list[float], list[bool]]:
        """Divergences, share of information lost and validity of each change of a feature, in one batch."""
        g: list[list[tuple]] = [[] for _ in changes]
        loss, valid = [0.0] * len(changes), [True] * len(changes)
        merges = [(str(i), old, c["merge"].get(old, old)) for i, c in enumerate(changes) if "merge" in c for old in self.levels[feature]]
        powers = [(i, c["power"]) for i, c in enumerate(changes) if "power" in c]
        before = self.nmi.get(feature, 1.0)
        if merges:
            table = F.broadcast(self.spark.createDataFrame(merges, "cand string, old string, new string"))  # candidates x categories
            own = self.cell.filter(F.col("feature") == feature).drop("feature").join(table, F.col("category") == F.col("old"))
            own = own.groupBy("attr", "grp", F.col("cand").alias("feature"), F.col("new").alias("category")).agg(F.sum("n").alias("n"), F.sum("sw").alias("sw"))
            own = materialize(own, "candidates")
            for r in G.div_cat(self._on_attrs(own)).collect():
                g[int(r.feature)].append((r.attr, r.grp_a, r.grp_b, float(r.g)))
            for r in P.nmi(self._on_y(own), ["feature"], y="grp", n=self.count, floor=LEAST_NMI).collect():
                loss[int(r.feature)] = (before - r.nmi) / before
            for r in own.groupBy("feature").agg(F.count_distinct("category").alias("n")).collect():
                valid[int(r.feature)] = r.n > 1
        if powers:
            moment = materialize(power_moments(self.df, self.attrs, feature, [p for _, p in powers], self.weight), "moments")
            for r in G.div_num(moment).collect():
                g[powers[int(r.feature)][0]].append((r.attr, r.grp_a, r.grp_b, float(r.g)))
            for r in moment.groupBy("feature").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():
                valid[powers[int(r.feature)][0]] = float("-inf") < r.lo < r.hi < float("inf")
        for i, c in enumerate(changes):
            if c == "dropped":
                loss[i] = (before - LEAST_NMI) / before
        return g, loss, valid

    def measured(self, feature: str, attr: str, changes: list) -> list[tuple]:
        """(change, distance for the attribute, loss, valid, accepted, divergences) of each change."""
        g, loss, valid = self.divergences(feature, changes)
        rest = {f: v for f, v in self.g.items() if f != feature}
        states = {i: rest | {feature: g[i]} for i in range(len(changes)) if g[i] and valid[i]}
        d = {}
        if states:
            d = {i: v for i, a, f, v in self.distances(states, feature) if (a, f) == (attr, feature)}
        out = []
        for i, c in enumerate(changes):
            dist = 0.0 if c == "dropped" else d.get(i)
            ok = valid[i] and dist is not None and dist < self.epsilon and loss[i] <= self.phi + 1e-12
            out.append((c, dist, loss[i], valid[i], ok, g[i]))
        return out

    def _search(self, feature: str, attr: str) -> tuple | None:
        """The first acceptable change, its distance and divergences."""
        now = self.state.get(feature, {})
        if feature in self.cats:
            chain = merge_chain(self.cell, feature, attr, now.get("merge"))
            found = self.measured(feature, attr, [{"merge": m} if left > 1 else "dropped" for m, left in chain])
            return next(((c, d, g) for c, d, _, _, ok, g in found if ok), None)
        begin = self.at.get(feature, 0) if self.cursor == "monotone" else 0
        while begin < len(self.powers):
            end = min(begin + self.batch, len(self.powers))
            tried = [(i, p) for i, p in enumerate(self.powers[begin:end], begin) if abs(p - 1) > 1e-12 and abs(p - now.get("power", 1.0)) > 1e-12]
            changes = ["dropped" if self._overflows(feature, p) else {"power": p} for _, p in tried]
            for (i, _), (c, d, _, _, ok, g) in zip(tried, self.measured(feature, attr, changes), strict=True):
                if ok:
                    self.at[feature] = i + 1
                    return c, d, g
            begin = self.at[feature] = end
        return None

    def _overflows(self, feature: str, p: float) -> bool:
        big = self.largest[feature]
        try:
            return big is not None and float(big) ** p > FLOAT32_MAX
        except OverflowError:
            return True

    def run(self) -> dict:
        """Steps until all features are under epsilon or the search ends; the state."""
        failed: set[tuple[str, str]] = set()
        seen = {json.dumps(self.state, sort_keys=True)}
        self.status = ""
        while not self.status:
            over = [r for r in self.ranking() if r[0] > self.epsilon]
            if not over:
                self.status = "CONVERGED"
            todo = [r for r in over if (r[1], r[2]) not in failed]
            if over and not todo:
                self.status = "EXHAUSTED"
            for before, attr, feature in todo[:1]:
                found = self._search(feature, attr)
                step, kind = len(self.trace), "categorical" if feature in self.cats else "numerical"
                if found is None:
                    self.trace.append((step, attr, feature, kind, None, before, before, "FAILED"))
                    failed.add((attr, feature))
                    if self.mode == "stop":
                        self.status = "EXHAUSTED"
                    continue
                change, after, g = found
                state = self.state | {feature: change}
                name = json.dumps(state, sort_keys=True)
                if name in seen:
                    self.trace.append((step, attr, feature, kind, json.dumps(change, sort_keys=True), before, before, "CYCLE"))
                    self.status = "CYCLE"
                    continue
                seen.add(name)
                self._take(feature, change, g)
                self.states.append(self.state)
                self.trace.append((step, attr, feature, kind, json.dumps(change, sort_keys=True), before, after, "ACCEPTED"))
        return self.state

    def _take(self, feature: str, change, g: list[tuple]) -> None:
        self.state = self.state | {feature: change}
        self.g = {f: v for f, v in self.g.items() if f != feature} | ({} if change == "dropped" else {feature: g})

    def trace_table(self) -> DataFrame:
        schema = "step int, attr string, feature string, kind string, change string, before double, after double, status string"
        return self.spark.createDataFrame(self.trace, schema)
