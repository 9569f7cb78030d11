"""Rank metrics: ties are one point of a curve, and curves are built by two-level running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import all_of, range_of, ratio, running


def _points(df: DataFrame, keys: list[str], y: str, score: str, w: Column | None) -> DataFrame:
    w = F.lit(1.0) if w is None else w.cast("double")
    return running(df, keys, score, {"pos": w * F.col(y), "neg": w * (1 - F.col(y))})


def _totals(points: DataFrame, keys: list[str]) -> DataFrame:
    # The running sums' largest values are the totals; one row per key.
    return points.groupBy(*keys).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))


def _join(points: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    return points.join(totals, keys) if keys else points.crossJoin(F.broadcast(totals))  # one row


def auroc(df: DataFrame, keys: list[str], y: str = "y", score: str = "p1", w: Column | None = None) -> DataFrame:
    """(keys, auroc), tie-aware; null if a class is absent."""
    points = _points(df, keys, y, score, w)
    below = F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2)
    return points.groupBy(*keys).agg(ratio(F.sum(below), F.sum("pos") * F.sum("neg")).alias("auroc"))


def pr_curve(df: DataFrame, keys: list[str], y: str = "y", score: str = "p1", w: Column | None = None) -> DataFrame:
    """(keys, score, precision, recall): predicted positive at the score or above."""
    points = _points(df, keys, y, score, w)
    both = _join(points, _totals(points, keys), keys)
    tp = F.col("all_pos") - F.col("cum_pos") + F.col("pos")
    fp = F.col("all_neg") - F.col("cum_neg") + F.col("neg")
    return both.select(*keys, score, "pos", "neg", "all_pos", "all_neg", tp.alias("tp"), fp.alias("fp"), ratio(tp, tp + fp).alias("precision"), ratio(tp, F.col("all_pos")).alias("recall"))


def average_precision(df: DataFrame, keys: list[str], y: str = "y", score: str = "p1", w: Column | None = None) -> DataFrame:
    """(keys, ap): the sum of precision times the step in recall, which is each point's own share."""
    curve = pr_curve(df, keys, y, score, w)
    return curve.groupBy(*keys).agg(F.sum(F.col("precision") * ratio(F.col("pos"), F.col("all_pos"))).alias("ap"))


def auprc_trapezoid(df: DataFrame, keys: list[str], y: str = "y", score: str = "p1", w: Column | None = None) -> DataFrame:
    """(keys, auprc): trapezoids under the curve, from recall 0 at precision 1."""
    curve = pr_curve(df, keys, y, score, w)
    # the point above has the totals without this point's own
    tp, fp = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    above = F.when(tp + fp > 1e-9, ratio(tp, tp + fp)).otherwise(1.0)
    area = ratio(F.col("pos"), F.col("all_pos")) * (F.col("precision") + above) / 2
    return curve.groupBy(*keys).agg(F.sum(area).alias("auprc"))


def ks_two_sample(df: DataFrame, keys: list[str], side: str = "y", value: str = "p1", low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(keys, ks): largest difference of the two distribution functions of ``value`` by ``side`` (0 or 1)."""
    points = running(df, keys, value, {"pos": F.col(side).cast("double"), "neg": 1.0 - F.col(side)}, low, high)
    both = _join(points, _totals(points, keys), keys)
    return both.groupBy(*keys).agg(F.max(F.abs(ratio(F.col("cum_pos"), F.col("all_pos")) - ratio(F.col("cum_neg"), F.col("all_neg")))).alias("ks"))


def brier(df: DataFrame, keys: list[str], y: str = "y", score: str = "p1", w: str = "w") -> DataFrame:
    return df.groupBy(*keys).agg(ratio(F.sum(F.col(w) * F.pow(F.col(y) - F.col(score), 2)), F.sum(w)).alias("brier"))


def calibration_curve(df: DataFrame, keys: list[str], y: str = "y", score: str = "p1", w: str = "w", bins: int = 10) -> DataFrame:
    """(keys, bin) n, weight share, mean score and observed rate; empty bins are rows with n = 0."""
    got = df.withColumn("bin", F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int"))
    got = got.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.sum(w).alias("sw"), F.sum(F.col(w) * F.col(score)).alias("sp"), F.sum(F.col(w) * F.col(y)).alias("sy"))
    every = got.select(*keys).distinct() if keys else got.limit(1).select()
    every = every.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    total = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # at most ``bins`` rows
    full = every.join(got, [*keys, "bin"], "left")
    return full.select(
        *keys, "bin", F.coalesce("n", F.lit(0)).alias("n"), ratio(F.coalesce("sw", F.lit(0.0)), F.sum("sw").over(total)).alias("weight_share"),
        ratio(F.col("sp"), F.col("sw")).alias("mean_score"), ratio(F.col("sy"), F.col("sw")).alias("observed_rate"),
    )


def threshold_search_ba(df: DataFrame, keys: list[str], y: str = "y", score: str = "p1") -> DataFrame:
    """(keys, threshold, ba): best balanced accuracy over midpoints, 0 and 1; ties go to the one nearest 0.5, then the larger."""
    points = _points(df, keys, y, score, None)
    both = _join(points, _totals(points, keys), keys)
    # The next score lies in this range, or is the first of the next range that has one.
    both = both.withColumn("_range", range_of(F.col(score)))
    first = both.groupBy(*keys, "_range").agg(F.min(score).alias("_first"))
    first = first.withColumn("_later", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_range"))).drop("_first")  # a row per range
    both = both.alias("p").join(first.alias("q"), all_of([F.col(f"p.{k}").eqNullSafe(F.col(f"q.{k}")) for k in [*keys, "_range"]]))
    both = both.select("p.*", "q._later")
    inside = F.lead(score).over(Window.partitionBy(*keys, "_range").orderBy(score))
    both = both.withColumn("threshold", (F.col(score) + F.coalesce(inside, "_later")) / 2)
    tp, tn = F.col("all_pos") - F.col("cum_pos"), F.col("cum_neg")  # at the midpoint above this score
    mid = both.filter(F.col("threshold").isNotNull()).select(*keys, "threshold", "all_pos", "all_neg", tp.alias("tp"), tn.alias("tn"))
    low = both.filter(F.col("cum_pos") + F.col("cum_neg") == F.col("pos") + F.col("neg"))
    zero = low.select(*keys, F.lit(0.0).alias("threshold"), "all_pos", "all_neg", F.col("all_pos").alias("tp"), F.lit(0.0).alias("tn"))
    at1 = F.when(F.col(score) >= 1.0, F.lit(1.0)).otherwise(0.0)
    one = both.groupBy(*keys, "all_pos", "all_neg").agg(F.sum(F.col("pos") * at1).alias("tp"), F.sum(F.col("neg") * (1 - at1)).alias("tn"))
    one = one.select(*keys, F.lit(1.0).alias("threshold"), "all_pos", "all_neg", "tp", "tn")
    cand = mid.unionByName(zero).unionByName(one).withColumn("ba", F.round((ratio(F.col("tp"), F.col("all_pos")) + ratio(F.col("tn"), F.col("all_neg"))) / 2, 12))
    best = F.max_by(F.struct("threshold", "ba"), F.struct("ba", -F.round(F.abs(F.col("threshold") - 0.5), 9), "threshold")).alias("b")
    return cand.groupBy(*keys).agg(best).select(*keys, "b.threshold", "b.ba")


def utility_metrics(df: DataFrame, keys: list[str], y: str = "y", score: str = "p1", pred: str = "yhat") -> DataFrame:
    """AUROC, AP, balanced accuracy, F1 and accuracy; null with a reason where undefined."""
    from .metrics import counts, rate_columns

    r = rate_columns(None)
    base = df.groupBy(*keys).agg(*counts(F.col(y), F.col(pred))).withColumns(
        {"ba": (r["TPR"] + r["TNR"]) / 2, "f1": ratio(2 * F.col("tp"), F.expr("2 * tp + fp + fn")), "accuracy": r["ACC"]}
    )
    one_class = (F.expr("tp + fn") == 0) | (F.expr("tn + fp") == 0)
    base = base.withColumn("status", F.when(one_class, "SINGLE_CLASS").otherwise("VALID"))
    out = base.select(*keys, "ba", "f1", "accuracy", "status")
    for other in (auroc(df, keys, y, score), average_precision(df, keys, y, score)):
        out = out.join(other, keys) if keys else out.crossJoin(F.broadcast(other))  # one row
    return out.withColumns({c: F.when(F.col("status") == "VALID", F.col(c)) for c in ("auroc", "ap", "ba")})
