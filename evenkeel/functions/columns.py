"""Column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, undefined: float | None = None) -> Column:
    """a / b as a double; null, or ``undefined``, where b is 0 or null."""
    out = a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))
    return out if undefined is None else F.coalesce(out, F.lit(undefined))


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Every double column rounded to six decimals."""
    return df.select([r6(c).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def unpivot(df: DataFrame, cols: list[str], name: str, value: str, keep: list[str] | None = None) -> DataFrame:
    """Long form with (name, value as string); ``keep`` are the other columns to carry (all by default)."""
    keep = [c for c in df.columns if c not in (name, value)] if keep is None else keep
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("string").alias(value)) for c in cols])
    return df.select(*keep, F.inline(pairs))


def by_attr(df: DataFrame, attrs: list[str] | tuple[str, ...], keep: list[str] | None = None) -> DataFrame:
    """Protected attributes in long form: (attr, grp)."""
    return unpivot(df, list(attrs), "attr", "grp", keep)


def dim(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def all_of(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, cols)


def range_of(x: Column, low: float = 0.0, high: float = 1.0, buckets: int = 1024) -> Column:
    """The range that holds x: one of ``buckets`` equal ones of [low, high], or, outside of it, one of 64 for each
    doubling of the distance to its end.  A larger x has a range as large or larger; NaN is the largest."""
    unit = (x - low) / (high - low)

    def beyond(distance: Column) -> Column:
        return F.floor(F.least(64 * F.log2(1 + distance * buckets), F.lit(131_072.0)))

    return F.when(unit > 1, buckets + beyond(unit - 1)).when(unit < 0, -1 - beyond(-unit)).otherwise(F.floor(unit * buckets)).cast("int")


def above(x: Column, cuts: list[float]) -> Column:
    """How many of the cuts lie below x."""
    return reduce(lambda n, c: n + F.when(x > c, 1).otherwise(0), cuts, F.lit(0))


def quantile_cuts(df: DataFrame, col: str, ranges: int = 128) -> list[float]:
    """Ends of ranges that hold about as many rows each, for values of any distribution."""
    return sorted(set(df.approxQuantile(col, [i / ranges for i in range(1, ranges)], 1 / (4 * ranges))))


def running(
    df: DataFrame, keys: list[str], by: str, sums: dict[str, Column], low: float = 0.0, high: float = 1.0, buckets: int = 1024,
    cuts: list[float] | None = None,
) -> DataFrame:
    """One row per (keys, by) with the sums and their running totals ``cum_*`` in ascending ``by``.

    Two levels: running sums inside ranges of ``by``, plus the totals of the ranges before, so that no
    task sorts all values of a key.  Ranges are those of ``range_of``, or end at ``cuts``.
    """
    points = df.groupBy(*keys, by).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    points = points.withColumn("_range", range_of(F.col(by), low, high, buckets) if cuts is None else above(F.col(by), cuts))
    inner = Window.partitionBy(*keys, "_range").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = points.groupBy(*keys, "_range").agg(*[F.sum(n).alias(f"_t_{n}") for n in sums])
    totals = totals.select(*keys, "_range", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    points = points.withColumns({f"_i_{n}": F.sum(n).over(inner) for n in sums})
    joined = points.alias("p").join(totals.alias("q"), all_of([F.col(f"p.{k}").eqNullSafe(F.col(f"q.{k}")) for k in [*keys, "_range"]]))
    return joined.select(
        *[F.col(f"p.{k}").alias(k) for k in keys], by, *sums, *[(F.col(f"_i_{n}") + F.col(f"_o_{n}")).alias(f"cum_{n}") for n in sums]
    )
