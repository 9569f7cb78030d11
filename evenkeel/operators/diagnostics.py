"""Stepwise and reporting operators: windows and joins on result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import all_of, ratio
from ..functions.quantiles import with_quantiles


def stepwise_deltas(metrics: DataFrame, keys: list[str], state: str, value: str) -> DataFrame:
    """Adds the difference to the state before and to the first state."""
    w = Window.partitionBy(*keys).orderBy(state)
    first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return metrics.withColumn("d_previous", F.col(value) - F.lag(value).over(w)).withColumn("d_first", F.col(value) - first)


def key_path_top(deltas: DataFrame, keys: list[str], year: str, state: str, a: int, b: int, k: int = 3) -> DataFrame:
    """(keys, state, rank) the k largest |change| of year ``a`` beside year ``b``'s, and whether both go the same way (null at 0)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.abs("d_previous")), state)
    top = deltas.filter((F.col(year) == a) & F.col("d_previous").isNotNull()).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    other = deltas.filter(F.col(year) == b).select(*keys, state, F.col("d_previous").alias("other"))
    out = top.join(other, [*keys, state], "left")
    same = F.when((F.col("d_previous") != 0) & (F.col("other") != 0), F.signum("d_previous") == F.signum("other"))
    return out.select(*keys, state, "rank", F.col("d_previous").alias("delta"), "other", same.alias("same_direction"))


def category_states(df: DataFrame, before: dict[str, Column], after: dict[str, Column], y: str) -> DataFrame:
    """(feature, side, category) n, positives and prevalence, before and after a transform."""
    parts = [F.struct(F.lit(f).alias("feature"), F.lit(s).alias("side"), c.cast("string").alias("category")) for s, m in (("before", before), ("after", after)) for f, c in m.items()]
    long = df.select(F.col(y).alias("_y"), F.inline(F.array(*parts)))
    return long.groupBy("feature", "side", "category").agg(F.count("*").alias("n"), F.sum("_y").alias("positives"), ratio(F.sum("_y"), F.count("*")).alias("prevalence"))


def power_geometry(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(name) five quantiles of each of the raw, powered and scaled values."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), c.cast("double").alias("x")) for n, c in columns.items()])))
    return with_quantiles(long.select("name").distinct(), long, ["name"], F.col("x"), [0.0, 0.25, 0.5, 0.75, 1.0], [f"q{i}" for i in range(5)])


def score_distribution(df: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    """(keys, y) n, mean, std and median of a score; y null is overall."""
    grouped = df.groupingSets([keys, [*keys, y]], *keys, y)
    out = grouped.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.grouping(y).alias("_whole"))
    both = df.select(*keys, y, x, F.explode(F.array(F.lit(0).cast("tinyint"), F.lit(1).cast("tinyint"))).alias("_whole"))  # each row in its class and in all
    both = both.withColumn(y, F.when(F.col("_whole") == 0, F.col(y)))
    return with_quantiles(out, both, [*keys, y, "_whole"], F.col(x), [0.5], ["median"]).drop("_whole")


def logit_contributions(df: DataFrame, y: str, coefficients: dict[str, float]) -> DataFrame:
    """(feature) beta * mean by class, and beta * (mean1 - mean0)."""
    long = df.select(F.col(y).alias("_y"), F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(b).alias("beta"), F.col(f).cast("double").alias("x")) for f, b in coefficients.items()])))
    m1, m0 = F.avg(F.when(F.col("_y") == 1, F.col("x"))), F.avg(F.when(F.col("_y") == 0, F.col("x")))
    return long.groupBy("feature", "beta").agg((F.col("beta") * m1).alias("class1"), (F.col("beta") * m0).alias("class0"), (F.col("beta") * (m1 - m0)).alias("separation"))


def trace_aggregate(trace: DataFrame, keys: list[str], elapsed: str) -> DataFrame:
    """(keys) count and elapsed mean, median, min, max."""
    out = trace.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(elapsed).alias("mean"), F.min(elapsed).alias("min"), F.max(elapsed).alias("max")
    )
    return with_quantiles(out, trace, keys, F.col(elapsed), [0.5], ["median"])


def feature_frequency(trace: DataFrame, feature: str, seed: str, kind: str, kinds: list[str]) -> DataFrame:
    """(feature) in how many seeds each kind of change happened, and any."""
    return trace.groupBy(feature).agg(*[F.count_distinct(F.when(F.col(kind) == k, F.col(seed))).alias(k) for k in kinds], F.count_distinct(seed).alias("any"))


def compare_within(a: DataFrame, b: DataFrame, keys: list[str], value: str, tol: float) -> DataFrame:
    """(keys) both values, whether they agree within ``tol``, and a status that names a missing side."""
    x, y = a.alias("x"), b.alias("y")
    on = all_of([F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys])
    both = x.join(y, on, "full").select(*[F.coalesce(f"x.{k}", f"y.{k}").alias(k) for k in keys], F.col(f"x.{value}").alias("reference"), F.col(f"y.{value}").alias("observed"))
    status = F.when(F.col("reference").isNull(), "NO_REFERENCE").when(F.col("observed").isNull(), "NOT_OBSERVED")
    return both.withColumn("status", status.when(F.abs(F.col("reference") - F.col("observed")) <= tol, "MATCH").otherwise("DIFFERS"))


def result_flatten(nested: DataFrame, keys: list[str], struct: str) -> DataFrame:
    """Fields of a nested result as columns beside its keys."""
    return nested.select(*keys, f"{struct}.*")
