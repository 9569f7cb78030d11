"""Thresholds by group: the best ones within a bound on the equalised-odds gap, and mixtures that meet in one point."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import range_of, ratio, running
from ..sources.package import ship
from ..sources.tabular import materialize


def threshold_rates(df: DataFrame, grp: str, y: str, score: str, grid: list[float]) -> DataFrame:
    """(grp, t) n, pos, neg, tpr, fpr, right of a grid of thresholds, from one histogram of the scores over the grid."""
    below = F.size(F.filter(F.array(*[F.lit(t) for t in grid]), lambda t: t <= F.col(score)))  # thresholds met
    hist = df.groupBy(grp, below.alias("met")).agg(F.sum(y).alias("pos"), F.count("*").alias("n"))
    hist = hist.withColumn("neg", F.col("n") - F.col("pos"))
    steps = df.sparkSession.createDataFrame([(i + 1, float(t)) for i, t in enumerate(grid)], "i int, t double")
    joined = hist.join(F.broadcast(steps))  # groups x cells x grid, all small
    up = F.col("met") >= F.col("i")
    out = joined.groupBy(grp, "t").agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"), F.sum(F.when(up, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(up, F.col("neg")).otherwise(0)).alias("fp"))
    return out.select(
        grp, "t", (F.col("p") + F.col("q")).alias("n"), F.col("p").alias("pos"), F.col("q").alias("neg"), ratio(F.col("tp"), F.col("p")).alias("tpr"),
        ratio(F.col("fp"), F.col("q")).alias("fpr"), (F.col("tp") + F.col("q") - F.col("fp")).alias("right"),
    )


def group_threshold_grid(rates: DataFrame, grp: str, bound: float, objective: str = "accuracy") -> DataFrame:
    """(grp, t, objective, eo): one threshold a group, the best together while the equalised-odds gap is within ``bound``.

    The gap is the larger of the ranges that the groups' TPR and FPR span, so a choice is within ``bound`` if all
    its points lie in one window of that width in both rates, whose lower ends are rates of points.  The
    objective ("accuracy" or "ba", of all groups together) is a sum over groups, so inside a window each group
    takes its own best point: no product of the groups' grids is built.  Ties go to the smaller thresholds, in
    order of the groups.  A group without both outcomes is an error; without a choice within ``bound`` there is
    no row.
    """
    rates = materialize(rates, "rates")  # groups x grid
    if not rates.filter(F.col(grp).isNull() | F.col("tpr").isNull() | F.col("fpr").isNull()).isEmpty():
        raise ValueError("each group needs a name and both outcomes")
    size = rates.groupBy(grp).agg(F.first("n").alias("n"), F.first("pos").alias("pos"), F.first("neg").alias("neg"))
    size = size.agg(F.count("*").alias("_k"), F.sum("n").alias("_n"), F.sum("pos").alias("_p"), F.sum("neg").alias("_q"))
    points = rates.crossJoin(F.broadcast(size))  # one row
    if objective == "accuracy":
        gain = F.col("right") / F.col("_n")
    elif objective == "ba":
        gain = (F.col("tpr") * F.col("pos") / F.col("_p") + (1 - F.col("fpr")) * F.col("neg") / F.col("_q")) / 2
    else:
        raise ValueError(f"no objective {objective}")
    points = points.select(F.col(grp).alias("g"), "t", "tpr", "fpr", F.round(gain, 15).alias("gain"), "_k")
    wide = bound + 1e-12
    column = points.select(F.col("tpr").alias("a")).distinct().join(points, (F.col("tpr") >= F.col("a")) & (F.col("tpr") <= F.col("a") + wide))
    corner = column.select("a", F.col("fpr").alias("b")).distinct()
    window = column.join(corner, "a").filter((F.col("fpr") >= F.col("b")) & (F.col("fpr") <= F.col("b") + wide))
    best = window.groupBy("a", "b", "g", "_k").agg(F.max_by(F.struct("g", "t", "tpr", "fpr", "gain"), F.struct("gain", -F.col("t"))).alias("p"))
    whole = best.groupBy("a", "b", "_k").agg(F.sort_array(F.collect_list("p")).alias("p")).filter(F.size("p") == F.col("_k"))  # a point a group
    total = F.round(F.aggregate("p", F.lit(0.0), lambda s, p: s + p["gain"]), 12)
    whole = whole.withColumn("total", total)
    pick = whole.agg(F.max_by(F.struct("p", "total"), F.struct("total", F.transform("p", lambda p: -p["t"]))).alias("w"))
    span = F.greatest(*[F.array_max(F.col(f"w.p.{c}")) - F.array_min(F.col(f"w.p.{c}")) for c in ("tpr", "fpr")])
    out = pick.filter("w is not null").select(F.explode("w.p").alias("p"), F.col("w.total").alias(objective), span.alias("eo"))
    return out.select(F.col("p.g").alias(grp), F.col("p.t").alias("t"), objective, "eo")


def _upper_hull(part: pd.DataFrame) -> pd.DataFrame:
    """The vertices of the upper hull of points, by ascending FPR."""
    part = part.sort_values(["fpr", "tpr"], kind="stable")
    x, y = part.fpr.to_numpy(), part.tpr.to_numpy()
    keep: list[int] = []
    for i in range(len(x)):
        while len(keep) > 1:
            a, b = keep[-2], keep[-1]
            if (x[b] - x[a]) * (y[i] - y[a]) - (y[b] - y[a]) * (x[i] - x[a]) < 0:
                break
            keep.pop()
        keep.append(i)
    if len(keep) > 1 and x[keep[0]] == x[keep[1]]:  # of equal FPRs the higher point
        keep.pop(0)
    return part.iloc[keep]


def roc_hull(df: DataFrame, grp: str, y: str, score: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(grp, fpr, tpr, t): the vertices of each group's upper ROC hull, with (0, 0) at an infinite threshold.

    Points are the distinct scores; a hull is that of the hulls of ranges of the score, so that a task holds a
    range's points or what the ranges left, which grows as the two-thirds power of the points at most.
    """
    ship(df.sparkSession)
    points = running(df, [grp], score, {"pos": F.col(y).cast("double"), "neg": 1.0 - F.col(y)}, low, high)
    total = points.groupBy(grp).agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    joined = points.join(total, grp)
    tp, fp = F.col("p") - F.col("cum_pos") + F.col("pos"), F.col("q") - F.col("cum_neg") + F.col("neg")
    roc = joined.select(grp, range_of(F.col(score), low, high).alias("r"), ratio(fp, F.col("q")).alias("fpr"), ratio(tp, F.col("p")).alias("tpr"), F.col(score).cast("double").alias("t"))
    roc = roc.unionByName(total.select(grp, F.lit(-1).alias("r"), ratio(F.col("q") * 0, F.col("q")).alias("fpr"), ratio(F.col("p") * 0, F.col("p")).alias("tpr"), F.lit(float("inf")).alias("t")))
    kind = df.schema[grp].dataType.simpleString()
    first = roc.groupBy(grp, "r").applyInPandas(_upper_hull, f"{grp} {kind}, r int, fpr double, tpr double, t double")
    return first.groupBy(grp).applyInPandas(_upper_hull, f"{grp} {kind}, r int, fpr double, tpr double, t double").drop("r")


def _at(hull: DataFrame, xs: DataFrame, grp: str) -> DataFrame:
    """(grp, x, fpr, f0, r0, t0, f1, r1, t1): the segment of each group's hull at each x (the one to its left at a vertex)."""
    vertex = F.struct("fpr", "tpr", "t")
    rows = hull.select(grp, F.col("fpr").alias("x"), vertex.alias("v"), F.lit(0).alias("kind")).unionByName(
        hull.select(grp).distinct().crossJoin(F.broadcast(xs)).select(grp, "x", F.lit(None).cast("struct<fpr:double,tpr:double,t:double>").alias("v"), F.lit(1).alias("kind"))  # groups x xs
    )
    w = Window.partitionBy(grp).orderBy("x", "kind")
    rows = rows.withColumn("left", F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("right", F.first("v", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    return rows.filter("kind = 1").select(grp, "x", "left", F.coalesce("right", "left").alias("right"))


def _height(x: Column) -> Column:
    a, b = F.col("left"), F.col("right")
    span = b["fpr"] - a["fpr"]
    return F.when(span > 0, a["tpr"] + (x - a["fpr"]) / span * (b["tpr"] - a["tpr"])).otherwise(a["tpr"])


def group_threshold_eo(df: DataFrame, grp: str, y: str, score: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(grp, fpr, tpr, t_low, t_high, mix, ignore): per group a randomised decision that reaches one common (FPR, TPR) point.

    The point is the one of best balanced accuracy under all groups' upper ROC hulls.  A group decides by
    ``t_low`` with probability ``mix`` and by ``t_high`` otherwise, which is its hull at that FPR; if that lies
    above the common point, the decision is replaced with probability ``ignore`` by a constant one, yes with
    probability ``fpr``.  Groups need both outcomes (an error else).  Apply it with ``group_decision``.

    The lowest of the hulls less the diagonal is concave, so its top is a vertex of a hull or a crossing of two
    next to the best vertex; what reaches the driver are the segments there, two a group.
    """
    hull = materialize(roc_hull(df.filter(F.col(grp).isNotNull()), grp, y, score, low, high), "hull")
    if not hull.filter("fpr is null or tpr is null").isEmpty():
        raise ValueError("each group needs both outcomes")
    xs = hull.select(F.col("fpr").alias("x")).distinct()
    heights = materialize(_at(hull, xs, grp).withColumn("y", _height(F.col("x"))), "heights")
    least = heights.groupBy("x").agg(F.min("y").alias("y"))
    best = least.agg(F.max_by("x", F.struct(F.round(F.col("y") - F.col("x"), 12), -F.col("x"))).alias("x")).first().x
    if best is None:
        return df.sparkSession.createDataFrame([], _policy(df, grp))
    near = heights.agg(F.max(F.when(F.col("x") < best, F.col("x"))).alias("a"), F.min(F.when(F.col("x") > best, F.col("x"))).alias("b")).first()
    around = [v for v in (near.a, best, near.b) if v is not None]
    lines = heights.filter(F.col("x").isin(around)).select(grp, "x", "y").collect()
    names = sorted({r[0] for r in lines})
    table = {(r[0], r.x): r.y for r in lines}
    options = {x: min(table[g, x] for g in names) for x in around}
    for a, b in zip(around, around[1:], strict=False):
        ya, yb = (np.array([table[g, x] for g in names]) for x in (a, b))
        for i in range(len(names)):
            for j in range(i):
                d0, d1 = ya[i] - ya[j], yb[i] - yb[j]
                if d0 * d1 < 0:
                    s = d0 / (d0 - d1)
                    options[a + s * (b - a)] = float((ya + s * (yb - ya)).min())
    x = max(options, key=lambda v: (round(options[v] - v, 12), -v))
    spark = df.sparkSession
    at = _at(hull, spark.createDataFrame([(float(x),)], "x double"), grp).withColumn("y", _height(F.col("x")))
    common = float(options[x])
    span = F.col("right.fpr") - F.col("left.fpr")
    mix = F.when(span > 0, (F.col("x") - F.col("left.fpr")) / span).otherwise(0.0)
    above = F.when(F.col("y") - common > 1e-12, (F.col("y") - common) / (F.col("y") - F.col("x"))).otherwise(0.0)
    return at.select(grp, F.col("x").alias("fpr"), F.lit(common).alias("tpr"), F.col("right.t").alias("t_low"), F.col("left.t").alias("t_high"), mix.alias("mix"), above.alias("ignore"))


def _policy(df: DataFrame, grp: str) -> str:
    return f"{grp} {df.schema[grp].dataType.simpleString()}, fpr double, tpr double, t_low double, t_high double, mix double, ignore double"


def group_decision(df: DataFrame, policy: DataFrame, grp: str, score: str, out: str = "q_decision") -> DataFrame:
    """``df`` with the probability of a positive decision under the policy; null for a group that it does not know."""
    names = {c: f"_{c}" for c in policy.columns}
    known = F.broadcast(policy.withColumnsRenamed(names))  # a row per group
    joined = df.join(known, F.col(grp) == F.col(f"_{grp}"), "left")
    s = F.col(score)
    drawn = F.col("_mix") * (s >= F.col("_t_low")).cast("double") + (1 - F.col("_mix")) * (s >= F.col("_t_high")).cast("double")
    return joined.withColumn(out, F.col("_ignore") * F.col("_fpr") + (1 - F.col("_ignore")) * drawn).drop(*names.values())
