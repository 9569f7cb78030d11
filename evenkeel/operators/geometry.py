"""Bias geometry: divergences per feature and group pair, distances between features, concentration."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_attr, quantile_cuts, ratio, unpivot
from ..sources.package import ship
from ..sources.tabular import materialize

ORIGIN = "origin"


def cells(df: DataFrame, attrs: list[str], cats: list[str], w: str | None = None) -> DataFrame:
    """(attr, grp, feature, category) n, sw: the table behind all categorical divergences.  Nulls are dropped."""
    weight = F.col(w) if w else F.lit(1.0)
    long = by_attr(df.withColumn("_w", weight), attrs, [*[c for c in cats if c not in attrs], *[c for c in cats if c in attrs], "_w"])
    long = unpivot(long, cats, "feature", "category", ["attr", "grp", "_w"])
    ok = F.col("grp").isNotNull() & F.col("category").isNotNull() & (F.col("_w") > 0)
    return long.filter(ok).groupBy("attr", "grp", "feature", "category").agg(F.count("*").alias("n"), F.sum("_w").alias("sw"))


def moments(df: DataFrame, attrs: list[str], nums: list[str], w: str | None = None) -> DataFrame:
    """(attr, grp, feature) mean (weighted if asked), min and max."""
    weight = F.col(w) if w else F.lit(1.0)
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in nums])
    base = df.select(*attrs, weight.alias("_w"), pairs.alias("_p"))
    long = by_attr(base, attrs, ["_w", "_p"]).select("attr", "grp", "_w", F.inline("_p"))
    long = long.filter(F.col("grp").isNotNull() & F.col("x").isNotNull() & (F.col("_w") > 0))
    return long.groupBy("attr", "grp", "feature").agg(ratio(F.sum(F.col("_w") * F.col("x")), F.sum("_w")).alias("mean"), F.min("x").alias("lo"), F.max("x").alias("hi"))


def _pairs(table: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    a, b = table.alias("a"), table.alias("b")
    cond = F.col("a.grp") < F.col("b.grp")
    for c in on:
        cond = cond & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return a.join(b, cond, how)


def div_cat(cell: DataFrame, method: str = "a") -> DataFrame:
    """(attr, grp_a, grp_b, feature, g) over the union of categories, by weight share (a) or by counts (b)."""
    share = cell.withColumn("p", F.col("sw") / F.sum("sw").over(Window.partitionBy("attr", "grp", "feature")))
    groups = share.select("attr", "feature", "grp").distinct()
    pairs = _pairs(groups, ["attr", "feature"]).select(F.col("a.attr").alias("attr"), F.col("a.feature").alias("feature"), F.col("a.grp").alias("grp_a"), F.col("b.grp").alias("grp_b"))
    side = F.inline(F.array(F.struct(F.col("grp_a").alias("grp"), F.lit(1).alias("sign")), F.struct(F.col("grp_b").alias("grp"), F.lit(-1).alias("sign"))))
    long = pairs.select("attr", "feature", "grp_a", "grp_b", side).join(share, ["attr", "feature", "grp"])
    a, b = F.col("sign") == 1, F.col("sign") == -1
    per = long.groupBy("attr", "feature", "grp_a", "grp_b", "category").agg(
        F.sum(F.when(a, F.col("p")).otherwise(0.0)).alias("pa"), F.sum(F.when(b, F.col("p")).otherwise(0.0)).alias("pb"),
        F.sum(F.when(a, F.col("sw")).otherwise(0.0)).alias("na"), F.sum(F.when(b, F.col("sw")).otherwise(0.0)).alias("nb"),
    )
    if method == "a":
        g = F.sum(F.abs(F.col("pa") - F.col("pb"))) / F.count("*")
    else:
        g = F.sum(F.pow(F.col("na") - F.col("nb"), 2) / (F.col("na") + F.col("nb"))) / 2
    return per.groupBy("attr", "grp_a", "grp_b", "feature").agg(g.alias("g"))


def div_num(moment: DataFrame) -> DataFrame:
    """(attr, grp_a, grp_b, feature, g): difference of means after min-max scaling inside the pair.

    Scaling is linear, so the means need no second scan.
    """
    span = F.greatest("a.hi", "b.hi") - F.least("a.lo", "b.lo")
    d = F.abs(F.col("a.mean") - F.col("b.mean"))
    return _pairs(moment, ["attr", "feature"]).select(
        F.col("a.attr").alias("attr"), F.col("a.grp").alias("grp_a"), F.col("b.grp").alias("grp_b"), F.col("a.feature").alias("feature"),
        F.when(span > 0, d / span).otherwise(d).alias("g"),
    )


def div_nearest(df: DataFrame, attr: str, x: str, a: str, b: str, ranges: int = 64) -> DataFrame:
    """(g): mean distance from each row of one group to the nearest of the other, both ways, in one dimension.

    Neighbours come from a sort of the distinct values inside ranges that hold about as many of them each,
    whatever their distribution; the first and last value of each group per range carry over range borders,
    so no task sorts everything.
    """
    rows = df.filter(F.col(attr).isin(a, b) & F.col(x).isNotNull()).select((F.col(attr) == a).alias("ga"), F.col(x).cast("double").alias("x"))
    rows = materialize(rows.groupBy("ga", "x").agg(F.count("*").alias("n")), "points")
    cuts = F.array(*[F.lit(c) for c in quantile_cuts(rows, "x", ranges)]).cast("array<double>")
    rows = rows.withColumn("r", F.size(F.filter(cuts, lambda c: c < F.col("x"))))
    first, last = Window.orderBy("r").rowsBetween(1, Window.unboundedFollowing), Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy("r").agg(*[f(F.when(F.col("ga") == s, F.col("x"))).alias(f"{n}{int(s)}") for s in (True, False) for n, f in (("mn", F.min), ("mx", F.max))])
    # at most ``ranges`` rows
    border = per.select("r", *[F.min(f"mn{s}").over(first).alias(f"next{s}") for s in (1, 0)], *[F.max(f"mx{s}").over(last).alias(f"prev{s}") for s in (1, 0)])
    rows = rows.join(F.broadcast(border), "r")
    # both frames begin with the partition, as one that ends with it is taken anew for each row
    up, down = (Window.partitionBy("r").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow) for order in (F.asc("x"), F.desc("x")))
    other = lambda s: F.when(F.col("ga") != s, F.col("x"))
    cols = {}
    for s, n in ((True, 0), (False, 1)):
        below = F.coalesce(F.max(other(s)).over(up), F.col(f"prev{n}"))
        above = F.coalesce(F.min(other(s)).over(down), F.col(f"next{n}"))
        cols[f"near{int(s)}"] = F.least(F.col("x") - below, above - F.col("x"))
    near = rows.withColumns(cols).withColumn("d", F.when(F.col("ga"), F.col("near1")).otherwise(F.col("near0")))
    return near.filter("d is not null").agg(ratio(F.sum(F.col("d") * F.col("n")), F.sum("n")).alias("g"))


def div_scale(g: DataFrame, family: Column, how: str = "mean") -> DataFrame:
    """g divided by its family's mean or least value, or shifted z-scores, inside (attr, pair)."""
    w = Window.partitionBy("attr", "grp_a", "grp_b", family)
    if how == "mean":
        out = F.col("g") / F.nullif(F.avg("g").over(w), F.lit(0.0))
    elif how == "min":
        out = F.col("g") / F.nullif(F.min("g").over(w), F.lit(0.0))
    else:
        z = (F.col("g") - F.avg("g").over(w)) / F.nullif(F.stddev_pop("g").over(w), F.lit(0.0))
        g = g.withColumn("_z", z)
        out = F.col("_z") - F.min("_z").over(w)
    return g.withColumn("g", F.coalesce(out, F.lit(0.0))).drop("_z")


def weights_validate(df: DataFrame, grp: str, w: str) -> DataFrame:
    """(grp) total and bad weights with a status: finite, none negative, positive total."""
    out = df.groupBy(grp).agg(F.sum(w).alias("total"), F.count_if(F.col(w).isNull() | F.isnan(w) | (F.abs(F.col(w)) == float("inf")) | (F.col(w) < 0)).alias("bad"))
    return out.withColumn("status", F.when((F.col("bad") == 0) & (F.col("total") > 0), "PASS").otherwise("FAIL"))


def w_max(g: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, w): root mean square of g."""
    return g.groupBy(*keys).agg(F.coalesce(F.sqrt(F.avg(F.col("g") * F.col("g"))), F.lit(0.0)).alias("w"))


def exclusion_contexts(features: DataFrame, most: int, limit: int = 1_000_000) -> DataFrame:
    """(context, k): subsets of (feature) that leave out k <= ``most`` features, named by what they leave out.

    More than ``limit`` subsets are an error: distances go by the closed form, which needs none of them.
    """
    n = features.count()
    if sum(math.comb(n, k) for k in range(most + 1)) > limit:
        raise ValueError(f"more than {limit} contexts")
    names = features.select(F.col("feature").alias("x"))
    out = part = features.agg(F.lit("").alias("context"), F.lit(0).alias("k"), F.lit(None).cast("string").alias("last"))
    for k in range(1, min(most, n) + 1):  # what is left out, in ascending order
        part = part.join(names, F.col("last").isNull() | (F.col("x") > F.col("last"))).select(
            F.when(F.col("last").isNull(), F.col("x")).otherwise(F.concat_ws("+", "context", "x")).alias("context"), F.lit(k).alias("k"), F.col("x").alias("last")
        )
        out = out.unionByName(part)
    return out.select("context", "k")


def _left_out(sq: DataFrame, on: list[str], most: int, limit: int) -> DataFrame:
    """(on, outs, x, k): each set of up to ``most`` features that may be left out, with the sum of their squares."""
    if most > 1:
        n = sq.groupBy(*on).agg(F.count("*").alias("p")).agg(F.max("p")).first()[0] or 0
        if sum(math.comb(n, k) for k in range(min(most, n) + 1)) > limit:
            raise ValueError(f"more than {limit} contexts")
        most = min(most, n)
    part = sq.groupBy(*on).agg(F.array().cast("array<string>").alias("outs"), F.lit(0.0).alias("x"), F.lit(0).alias("k"), F.lit(None).cast("string").alias("last"))
    out = part
    one = sq.select(*on, "feature", "s")
    for k in range(1, most + 1):  # in ascending order of names
        grown = part.join(one, on).filter(F.col("last").isNull() | (F.col("feature") > F.col("last")))
        part = grown.select(*on, F.concat("outs", F.array("feature")).alias("outs"), (F.col("x") + F.col("s")).alias("x"), F.lit(k).alias("k"), F.col("feature").alias("last"))
        out = out.unionByName(part)
    return out.drop("last")


def distances(g: DataFrame, keys: list[str], aggregate: str = "mean_pair", most: int = 1, limit: int = 100_000) -> DataFrame:
    """(keys, node_a, node_b, d) between features, and to the origin, over contexts that leave out up to ``most`` others.

    By the closed form on squared g: with T the pair's sum over p features and x the sum of the squares left out
    (k features), w(S+a) = sqrt((T - g_b^2 - x) / (p - 1 - k)), w(S+m) = sqrt((T - x) / (p - k)) and
    w(S) = sqrt((T - g_m^2 - x) / (p - 1 - k)), 0 when empty.  What may be left out is a table of sums of
    squares, grown feature by feature, so no context's members are gathered; ``most`` of the number of features
    or more means all subsets, and more than ``limit`` of them are an error.  ``g`` has one row per (keys, pair,
    feature).
    """
    pair = ["grp_a", "grp_b"]
    sq = g.select(*keys, *pair, "feature", (F.col("g") * F.col("g")).alias("s"))
    total = sq.groupBy(*keys, *pair).agg(F.sum("s").alias("t"), F.count("*").alias("p"))
    left_out = _left_out(sq, [*keys, *pair], most, limit)

    def root(v: Column, n: Column) -> Column:
        return F.when(n > 0, F.sqrt(F.greatest(v, F.lit(0.0)) / F.greatest(n, F.lit(1)))).otherwise(0.0)

    def mean(table: DataFrame, v1: Column, v2: Column) -> DataFrame:
        table = table.select(*keys, *pair, "node_a", "node_b", "outs", v1.alias("v1"), v2.alias("v2"))
        if aggregate == "mean_pair":
            per = table.groupBy(*keys, "node_a", "node_b", "outs").agg(F.avg(F.abs(F.col("v1") - F.col("v2"))).alias("v"))
        else:
            per = table.groupBy(*keys, "node_a", "node_b", "outs").agg(F.abs(F.max("v1") - F.max("v2")).alias("v"))
        return per.groupBy(*keys, "node_a", "node_b").agg(F.avg("v").alias("d"))

    one = sq.join(total, [*keys, *pair])
    ta = one.select(*keys, *pair, F.col("feature").alias("node_a"), F.col("s").alias("sa"), "t", "p")
    tb = sq.select(*keys, *pair, F.col("feature").alias("node_b"), F.col("s").alias("sb"))
    two = ta.join(tb, [*keys, *pair]).filter(F.col("node_a") < F.col("node_b"))
    two = two.join(left_out, [*keys, *pair]).filter(~F.array_contains("outs", F.col("node_a")) & ~F.array_contains("outs", F.col("node_b")))
    n = F.col("p") - 1 - F.col("k")
    between = mean(two, root(F.col("t") - F.col("sb") - F.col("x"), n), root(F.col("t") - F.col("sa") - F.col("x"), n))

    zero = ta.withColumn("node_b", F.lit(ORIGIN)).join(left_out, [*keys, *pair]).filter(~F.array_contains("outs", F.col("node_a")))
    origin = mean(zero, root(F.col("t") - F.col("x"), F.col("p") - F.col("k")), root(F.col("t") - F.col("sa") - F.col("x"), n))
    return between.unionByName(origin)


def smacof(d: np.ndarray, dims: int, rounds: int = 300, tolerance: float = 1e-9) -> tuple[np.ndarray, float]:
    """Metric scaling of a distance matrix by majorisation from the classical solution: points, normalised stress."""
    n = len(d)
    j = np.eye(n) - 1 / n
    value, vector = np.linalg.eigh(-0.5 * j @ (d * d) @ j)
    top = np.argsort(-value)[:dims]
    x = vector[:, top] * np.sqrt(np.maximum(value[top], 0))
    x += 1e-9 * np.cos(np.arange(x.size).reshape(x.shape) + 1)  # no two points coincide exactly
    norm, last = (d * d).sum() / 2, np.inf
    for _ in range(rounds):
        e = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        stress = ((e - d) ** 2).sum() / 2
        if last - stress < tolerance * max(norm, 1e-300):
            break
        last = stress
        with np.errstate(divide="ignore", invalid="ignore"):
            b = -np.where(e > 0, d / e, 0)
        b[np.diag_indices(n)] = 0
        b[np.diag_indices(n)] = -b.sum(1)
        x = b @ x / n
    return x, float(np.sqrt(stress / norm)) if norm > 0 else 0.0


def embed(table: DataFrame, keys: list[str], dims: int | None = 2, most_dims: int = 15, drop: float = 0.01, rotate: bool = False) -> DataFrame:
    """(keys, feature, dphi, dim, stress, coord): each matrix is scaled, the origin moved to 0, a feature's norm is dphi.

    All matrices are one batch, a row group each.  ``dims`` None takes the first dimension after which the
    stress falls by less than ``drop``.  ``rotate`` turns the farthest point onto the first axis.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*part.node_a, *part.node_b} - {ORIGIN}) + [ORIGIN]
        at = {x: i for i, x in enumerate(names)}
        d = np.zeros((len(names), len(names)))
        i, j = part.node_a.map(at).to_numpy(), part.node_b.map(at).to_numpy()
        d[i, j] = d[j, i] = part.d.to_numpy()
        if not np.isfinite(d).all():
            raise ValueError("a distance is not finite")
        most = min(most_dims, len(names) - 1)
        if not d.any():
            x, dim, stress = np.zeros((len(names), 1)), 1, 0.0
        elif dims is not None:
            dim = min(dims, most)
            x, stress = smacof(d, dim)
        else:
            dim, (x, stress) = 1, smacof(d, 1)
            while dim < most:
                y, s = smacof(d, dim + 1)
                if stress - s < drop:
                    break
                dim, x, stress = dim + 1, y, s
        x = x - x[at[ORIGIN]]
        if rotate and x.any():
            axis = x[np.argmax((x * x).sum(1))]
            q, _ = np.linalg.qr(np.column_stack([axis, np.eye(x.shape[1])]))
            x = x @ q[:, : x.shape[1]]
            x *= np.where(x[np.argmax((x * x).sum(1))] < 0, -1, 1)
        out = {k: part[k].iloc[0] for k in keys}
        rows = [(*out.values(), f, float(np.linalg.norm(x[at[f]])), dim, stress, x[at[f]].tolist()) for f in names[:-1]]
        return pd.DataFrame(rows, columns=[*keys, "feature", "dphi", "dim", "stress", "coord"])

    ship(table.sparkSession)
    kinds = ", ".join(f"{k} {table.schema[k].dataType.simpleString()}" for k in keys)
    return table.groupBy(*keys).applyInPandas(run, f"{kinds}, feature string, dphi double, dim int, stress double, coord array<double>")


def epsilon_ratio(d: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    return d.groupBy(*keys).agg((F.avg(value) * share).alias("epsilon"))


def epsilon_kmeans_125(d: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, epsilon): mean of the lower of two clusters in one dimension, rounded up to 1, 2 or 5 times a power of ten."""
    w = Window.partitionBy(*keys).orderBy(value, "node_a")
    upto, whole = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    v, n = F.col(value), F.count("*").over(whole)
    rows = d.filter(v.isNotNull() & (v >= 0)).select(
        *keys, v.alias("v"), F.row_number().over(w).alias("i"), n.alias("n"), F.sum(v).over(upto).alias("s"), F.sum(v * v).over(upto).alias("q"),
        F.sum(v).over(whole).alias("all_s"), F.sum(v * v).over(whole).alias("all_q"),
    )
    rest = F.greatest(F.col("n") - F.col("i"), F.lit(1))
    wcss = F.col("q") - F.col("s") * F.col("s") / F.col("i") + (F.col("all_q") - F.col("q")) - F.pow(F.col("all_s") - F.col("s"), 2) / rest
    rows = rows.withColumn("wcss", F.when(F.col("i") < F.col("n"), F.round(wcss, 14)))
    agg = rows.groupBy(*keys).agg(
        F.min_by(F.col("s") / F.col("i"), F.when(F.col("wcss").isNotNull(), F.struct("wcss", "i"))).alias("low"),
        F.max(F.col("all_s") / F.col("n")).alias("mean"),
        F.max(F.sqrt(F.greatest(F.col("all_q") / F.col("n") - F.pow(F.col("all_s") / F.col("n"), 2), F.lit(0.0)))).alias("sd"),
    )
    m = F.when(F.col("sd") < 1e-8, F.col("mean")).otherwise(F.coalesce("low", "mean"))
    agg = agg.withColumn("m", m).withColumn("e", F.pow(F.lit(10.0), F.floor(F.log10(F.when(F.col("m") > 0, F.col("m"))))))
    f = F.col("m") / F.col("e")
    step = F.when(f <= 1 + 1e-9, 1.0).when(f <= 2 + 1e-9, 2.0).when(f <= 5 + 1e-9, 5.0).otherwise(10.0)
    return agg.select(*keys, F.coalesce(step * F.col("e"), F.lit(1e-4)).alias("epsilon"))


def geometry_diagnostics(df: DataFrame, attr: str, features: list[str]) -> DataFrame:
    """(feature) groups, fewest valid rows, distinct values, status of what a divergence needs."""
    long = unpivot(df, features, "feature", "v", [attr]).filter(F.col(attr).isNotNull())
    per = long.groupBy("feature", attr).agg(F.count("*").alias("rows"), F.count("v").alias("valid"))
    kinds = long.groupBy("feature").agg(F.count_distinct("v").alias("distinct"))
    out = per.groupBy("feature").agg(F.count("*").alias("groups"), F.sum("rows").alias("rows"), F.min("valid").alias("least_valid"), F.sum(F.col("rows") - F.col("valid")).alias("missing")).join(kinds, "feature")
    status = F.when(F.col("groups") < 2, "SINGLE_GROUP").when(F.col("least_valid") == 0, "EMPTY_GROUP").when(F.col("distinct") < 2, "CONSTANT").otherwise("OK")
    return out.withColumn("status", status)
