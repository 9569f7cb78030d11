"""Preprocessing: fitted on one partition as a small table or expression, applied to all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ratio, unpivot
from ..functions.quantiles import exact_quantiles
from ..sources.tabular import materialize


def infer_types(df: DataFrame, cols: list[str], legacy: bool = False, approximate: bool = False) -> DataFrame:
    """(column, n_distinct, kind) from one aggregate.

    Current rule: float, or over 5 distinct values, is numeric.  Legacy rule: boolean is categorical,
    time is numeric, numbers need 20 distinct values, and text of numbers a distinct ratio of 0.1.
    ``approximate`` counts distinct values by sketch, for tables where exact counts are too dear.
    """
    count = F.approx_count_distinct if approximate else F.count_distinct
    aggs = [F.count("*").alias("rows")]
    for c in cols:
        text = F.col(c).cast("string")
        aggs += [count(c).alias(f"d_{c}"), F.count_if(text.isNotNull() & text.try_cast("double").isNull()).alias(f"x_{c}")]
    one = df.agg(*aggs)
    types = dict(zip(df.columns, [f.dataType for f in df.schema.fields], strict=True))
    rows = []
    for c in cols:
        d, kind = F.col(f"d_{c}"), types[c]
        fractional = isinstance(kind, (T.DoubleType, T.FloatType))
        if isinstance(kind, T.BooleanType):
            numeric = F.lit(False)
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            numeric = F.lit(legacy) | (d > 5)
        elif isinstance(kind, T.NumericType):
            numeric = d >= 20 if legacy else F.lit(fractional) | (d > 5)
        elif legacy:
            numeric = (F.col(f"x_{c}") == 0) & (d / F.col("rows") >= 0.1)
        else:
            numeric = (F.col(f"x_{c}") == 0) & (d > 5)
        rows.append(F.struct(F.lit(c).alias("column"), d.alias("n_distinct"), F.when(numeric, "numerical").otherwise("categorical").alias("kind")))
    return one.select(F.inline(F.array(*rows)))


def select_roles(df: DataFrame, y: str, attrs: list[str], exclude: list[str]) -> tuple[list[str], DataFrame]:
    """Feature names (all but the outcome, protected and excluded columns) and the frame of all roles."""
    features = [c for c in df.columns if c not in {y, *attrs, *exclude}]
    return features, df.select(y, *attrs, *features)


def medians(fit: DataFrame, cols: list[str]) -> DataFrame:
    """One row with the exact median of each column."""
    long = fit.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in cols])))
    q = exact_quantiles(long, ["feature"], F.col("x"), [0.5])
    return q.agg(*[F.max(F.when(F.col("feature") == c, F.get("q", F.lit(0)))).alias(c) for c in cols])


def median_binarize(df: DataFrame, fit: DataFrame, col: str) -> DataFrame:
    """Adds ``<col>_bin``: 1 above the fit partition's median."""
    m = medians(fit, [col]).select(F.col(col).alias("_m"))
    return df.crossJoin(F.broadcast(m)).withColumn(f"{col}_bin", (F.col(col) > F.col("_m")).cast("int")).drop("_m")  # one row


def edges_of(fit: DataFrame, col: str, bins: int) -> DataFrame:
    """One row with the inner quantile edges, repeated ones dropped."""
    inner = [i / bins for i in range(1, bins)]
    return exact_quantiles(fit, [], F.col(col), [0.0, *inner, 1.0], "_e").select(F.array_distinct("_e").alias("_e"))


def qcut(df: DataFrame, fit: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Adds ``<col>_bin``: right-closed quantile bins from 0; values outside go to the end bins."""
    joined = df.crossJoin(F.broadcast(edges_of(fit, col, bins)))  # one row
    # inner edges below the value
    below = F.size(F.filter(F.slice("_e", 2, F.greatest(F.size("_e") - 2, F.lit(0))), lambda e: e < F.col(col)))
    return joined.withColumn(f"{col}_bin", F.when(F.col(col).isNotNull(), below)).drop("_e")


def levels(fit: DataFrame, col: str) -> DataFrame:
    """(level, code): sorted levels of the fit partition from 0; as many rows as levels.

    Levels are numbered inside ranges of them, after the totals of the ranges before, so that no task sees all.
    """
    distinct = fit.select(F.col(col).cast("string").alias("level")).filter("level is not null").distinct()
    # written, so that a range is the same one wherever it is read
    placed = materialize(distinct.repartitionByRange("level").withColumn("_r", F.spark_partition_id()), "levels")
    upto = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = placed.groupBy("_r").agg(F.count("*").alias("n")).select("_r", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_r").orderBy("level")) - 1
    return placed.withColumn("_i", inside).join(before, "_r").select("level", (F.col("_before") + F.col("_i")).cast("int").alias("code"))


def label_encode(df: DataFrame, fit: DataFrame, col: str) -> DataFrame:
    """Adds ``<col>_code``; an unseen or null level gets the number of levels."""
    lv = levels(fit, col)
    size = lv.agg(F.count("*").cast("int").alias("_k"))
    out = df.join(lv, F.col(col).cast("string") == F.col("level"), "left").crossJoin(F.broadcast(size))  # one row
    return out.withColumn(f"{col}_code", F.coalesce("code", "_k")).drop("level", "code", "_k")


def label_decode(df: DataFrame, fit: DataFrame, col: str, code: str) -> DataFrame:
    """Adds ``<col>_level``: the level of the fit partition that a code stands for; null for the sentinel, or a null code."""
    lv = levels(fit, col).select(F.col("level").alias("_level"), F.col("code").alias("_code"))
    return df.join(lv, F.col(code) == F.col("_code"), "left").withColumnRenamed("_level", f"{col}_level").drop("_code")


def partition_encode(df: DataFrame, fit: DataFrame, cats: list[str], nums: list[str]) -> DataFrame:
    """Fitted codes for categories; numbers that do not parse become 0."""
    for c in cats:
        df = label_encode(df, fit, c)
    return df.withColumns({f"{c}_num": F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in nums})


def median_impute(df: DataFrame, fit: DataFrame, col: str, low: float, high: float) -> DataFrame:
    """Adds ``<col>_imp``: null or out of range becomes the fit median of the valid rows; without any it is an error."""
    m = medians(fit.filter(F.col(col).between(low, high)), [col]).withColumnRenamed(col, "_m")
    m = m.select(F.coalesce("_m", F.raise_error(F.lit(f"{col} has no valid row")).cast("double")).alias("_m"))
    ok = F.when(F.col(col).between(low, high), F.col(col))
    return df.crossJoin(F.broadcast(m)).withColumn(f"{col}_imp", F.coalesce(ok, F.col("_m"))).drop("_m")  # one row


def sentinel(c: Column, substantive: list) -> Column:
    return F.when(c.isin(substantive), c).otherwise(F.lit(-1))


def fit_guard(df: DataFrame, col: str, allowed: list) -> DataFrame:
    """The frame itself; any other role or year in it is an error."""
    if odd := [r[0] for r in df.select(col).distinct().filter(~F.col(col).isin(allowed)).limit(3).collect()]:
        raise ValueError(f"rows of {odd} may not be fitted on")
    return df


def minmax_scale(df: DataFrame, fit: DataFrame, cols: list[str]) -> DataFrame:
    """Adds ``<col>_mm``; a constant column is only shifted."""
    s = fit.agg(*[F.min(c).alias(f"_lo_{c}") for c in cols], *[F.max(c).alias(f"_hi_{c}") for c in cols])
    out = df.crossJoin(F.broadcast(s))  # one row
    span = {c: F.when(F.col(f"_hi_{c}") > F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")).otherwise(1.0) for c in cols}
    out = out.withColumns({f"{c}_mm": (F.col(c) - F.col(f"_lo_{c}")) / span[c] for c in cols})
    return out.drop(*[f"_{p}_{c}" for c in cols for p in ("lo", "hi")])


def zscore_scale(df: DataFrame, fit: DataFrame, cols: list[str]) -> DataFrame:
    """Adds ``<col>_z`` with the population deviation; a constant column is only shifted."""
    s = fit.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    out = df.crossJoin(F.broadcast(s))  # one row
    out = out.withColumns({f"{c}_z": (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in cols})
    return out.drop(*[f"_{p}_{c}" for c in cols for p in ("m", "s")])


def vocabulary(fit: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, level, pos): levels in order, then MISSING and UNKNOWN."""
    got = unpivot(fit, cols, "feature", "level", []).filter("level is not null").distinct()
    got = got.withColumn("rank", F.lit(0))
    extra = fit.sparkSession.createDataFrame([(c, x, r) for c in cols for x, r in (("MISSING", 1), ("UNKNOWN", 2))], "feature string, level string, rank int")
    every = got.unionByName(extra)
    return every.withColumn("pos", F.row_number().over(Window.partitionBy("feature").orderBy("rank", "level")) - 1).drop("rank")


def vocab_onehot(df: DataFrame, fit: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """(key, feature, level, pos): the one position that is 1, in long form."""
    vocab = vocabulary(fit, cols)
    long = unpivot(df, cols, "feature", "raw", [key])
    known = long.join(vocab.select("feature", F.col("level").alias("raw"), F.lit(True).alias("known")), ["feature", "raw"], "left")
    level = F.when(F.col("raw").isNull(), "MISSING").when(F.col("known"), F.col("raw")).otherwise("UNKNOWN")
    return known.withColumn("level", level).join(vocab, ["feature", "level"]).select(key, "feature", "level", "pos")


def entropy(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """(keys, h) of a count table."""
    total = counts.groupBy(*keys).agg(F.sum(n).alias("_t"))
    p = F.col(n) / F.col("_t")
    return counts.join(total, keys).groupBy(*keys).agg(-F.sum(p * F.ln(p)), ).toDF(*keys, "h")


def nmi(cells: DataFrame, keys: list[str], x: str = "category", y: str = "y", n: str = "n", floor: float = 1e-6) -> DataFrame:
    """(keys, nmi) of a contingency table: mutual information over the mean of both entropies, ``floor`` at least."""
    cells = cells.groupBy(*keys, x, y).agg(F.sum(n).alias("n"))
    hx = entropy(cells.groupBy(*keys, x).agg(F.sum("n").alias("n")), keys).withColumnRenamed("h", "hx")
    hy = entropy(cells.groupBy(*keys, y).agg(F.sum("n").alias("n")), keys).withColumnRenamed("h", "hy")
    hxy = entropy(cells, keys).withColumnRenamed("h", "hxy")
    out = hx.join(hy, keys).join(hxy, keys)
    mi = F.col("hx") + F.col("hy") - F.col("hxy")
    return out.select(*keys, F.greatest(F.coalesce(ratio(mi, (F.col("hx") + F.col("hy")) / 2), F.lit(1.0)), F.lit(floor)).alias("nmi"))
