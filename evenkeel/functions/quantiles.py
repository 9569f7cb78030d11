"""Exact quantiles without a sort of all values, or a buffer of all distinct ones.

A pass cuts the values that are still in question into ranges of about equal counts (approximate quantiles give
the ends, a histogram the exact counts), and keeps for each wanted rank the one range that holds it.  When no
range holds more than ``most`` values, or repeated ones only, the rank is counted out among its values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tabular import materialize
from .columns import all_of

RANGES = 256
#: Keys and ranks whose brackets are broadcast (2 KB each); with more of them, rows are joined by key.
BROADCAST_KEYS = 10_000


def exact_quantiles(df: DataFrame, keys: list[str], value: Column, probs: list[float], name: str = "q", most: int = 50_000, rounds: int = 6, count: Column | None = None) -> DataFrame:
    """(keys, ``name``: array of the quantiles), interpolated linearly between ranks; nulls do not count.

    With ``count`` a row stands for so many equal ones.
    A key without a value has no row; without ``keys`` there is always one row.  Null keys are a key.
    """
    key = F.struct(*keys) if keys else F.lit(0)
    rows = df.select(key.alias("k"), value.cast("double").alias("v"), *([] if count is None else [count.alias("c")]))
    rows = materialize(rows.filter("v is not null"), "values")
    size = F.count("*") if count is None else F.sum("c")
    grid = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    approximate = F.percentile_approx("v", grid, 10 * RANGES).alias("cuts")

    def checked(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if table.count() <= BROADCAST_KEYS else table

    def narrowed(inside: DataFrame, at: list[str], keep: list[str]) -> DataFrame:
        """Counts of each range of the values at hand, with those of the ranges before."""
        cuts = materialize(inside.groupBy(*at).agg(approximate), "cuts")
        joined = inside.join(checked(cuts), at)
        r = F.size(F.filter("cuts", lambda c: c < F.col("v")))
        joined = joined.withColumn("r", r)
        low, high = F.get("cuts", F.col("r") - 1), F.get("cuts", F.col("r"))
        if "lo" in inside.columns:
            low, high = F.coalesce(low, "lo"), F.coalesce(high, "hi")
        hist = joined.groupBy(*at, *keep, "r", low.alias("low"), high.alias("high")).agg(size.alias("n"), F.count("*").alias("m"))
        before = Window.partitionBy(*at).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows at most
        return hist.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))

    hist = narrowed(rows, ["k"], []).withColumn("total", F.sum("n").over(Window.partitionBy("k")))
    wanted = []
    for j, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("total") - 1)
        wanted += [F.struct(F.lit(j).alias("j"), F.lit(s).alias("s"), pos.alias("pos"), f(pos).cast("long").alias("rank")) for s, f in enumerate((F.floor, F.ceil))]
    hist = hist.withColumn("t", F.explode(F.array(*wanted)))
    held = (F.col("before") <= F.col("t.rank")) & (F.col("t.rank") < F.col("before") + F.col("n"))
    place = ["k", "j", "s"]
    target = hist.filter(held).select("k", "t.*", F.col("low").alias("lo"), F.col("high").alias("hi"), F.col("before").alias("below"), "m")
    for _ in range(rounds):
        target = materialize(target, "brackets")
        within = (F.col("lo").isNull() | (F.col("v") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("v") <= F.col("hi")))
        other = checked(target.drop("m").withColumnRenamed("k", "of"))
        inside = rows.join(other, (F.col("k") == F.col("of")) & within).drop("of")
        if not (target.agg(F.max("m")).first()[0] or 0) > most:
            break
        hist = narrowed(inside, place, ["pos", "rank", "lo", "hi", "below"])
        held = (F.col("below") + F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("before") + F.col("n"))
        target = hist.filter(held).select(*place, "pos", "rank", F.col("low").alias("lo"), F.col("high").alias("hi"), (F.col("below") + F.col("before")).alias("below"), "m")
    points = inside.groupBy(*place, "pos", "rank", "below", "v").agg(size.alias("n"))
    upto = Window.partitionBy(*place).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    points = points.withColumn("end", F.col("below") + F.sum("n").over(upto)).filter((F.col("rank") < F.col("end")) & (F.col("rank") >= F.col("end") - F.col("n")))
    pair = points.groupBy("k", "j", "pos").agg(F.max(F.when(F.col("s") == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("s") == 1, F.col("v"))).alias("b"))
    pos = F.col("pos")
    between = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.ceil(pos) - pos) * F.col("a") + (pos - F.floor(pos)) * F.col("b"))
    out = pair.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("j", between.alias("v")))).alias(name))
    out = out.withColumn(name, F.transform(name, lambda x: x["v"]))
    return out.select(*[F.col("k")[c].alias(c) for c in keys], name) if keys else out.agg(F.first(name).alias(name))


def with_quantiles(out: DataFrame, df: DataFrame, keys: list[str], value: Column, probs: list[float], names: list[str], count: Column | None = None) -> DataFrame:
    """``out``, a row per key, with the quantiles of ``value`` in ``df`` as columns; null where a key has no value."""
    q = exact_quantiles(df, keys, value, probs, "_q", count=count)
    other = q.withColumnsRenamed({c: f"_{c}" for c in keys})
    on = all_of([F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]) if keys else F.lit(True)
    joined = out.join(other, on, "left") if keys else out.crossJoin(F.broadcast(other))  # a row per key, or one row
    return joined.withColumns({n: F.get("_q", F.lit(i)) for i, n in enumerate(names)}).drop("_q", *[f"_{c}" for c in keys])
