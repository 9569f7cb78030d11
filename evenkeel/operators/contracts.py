"""Source contracts: violations come back as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import unpivot

NUMERIC = ("integer", "float")


def schema_audit(df: DataFrame, registry: list[tuple[str, str, str]]) -> DataFrame:
    """(variable, role, declared_type, present, n_value, n_nonnumeric, status) of each registered variable."""
    here = [r for r in registry if r[0] in df.columns]
    spark = df.sparkSession
    out = spark.createDataFrame([(*r, r[0] in df.columns) for r in registry], "variable string, role string, declared_type string, present boolean")
    aggs = []
    for name, *_ in here:
        c = F.col(name).cast("string")
        aggs += [F.count(c).alias(f"n_{name}"), F.count_if(c.isNotNull() & c.try_cast("double").isNull()).alias(f"x_{name}")]
    rows = F.array(*[F.struct(F.lit(n).alias("variable"), F.col(f"n_{n}").alias("n_value"), F.col(f"x_{n}").alias("n_nonnumeric")) for n, *_ in here])
    stats = df.agg(*aggs).select(F.inline(rows))
    out = out.join(stats, "variable", "left")
    bad = ~F.col("present") | (F.col("declared_type").isin(*NUMERIC) & (F.col("n_nonnumeric") > 0))
    return out.withColumn("status", F.when(bad, "FAIL").otherwise("PASS"))


def code_domain_check(df: DataFrame, domain: DataFrame, nullable: list[str]) -> DataFrame:
    """(variable, n_outside, n_null, status): values outside the declared codes; nulls only where allowed.

    ``domain`` is (variable, code).
    """
    names = [r.variable for r in domain.select("variable").distinct().collect()]  # of the registry
    long = unpivot(df, sorted(names), "variable", "code", []).groupBy("variable", "code").agg(F.count("*").alias("n"))
    known = domain.withColumn("known", F.lit(True))
    joined = long.join(known, ["variable", "code"], "left")
    out = joined.groupBy("variable").agg(
        F.coalesce(F.sum(F.when(F.col("code").isNotNull() & F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("n_outside"),
        F.coalesce(F.sum(F.when(F.col("code").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
    )
    bad = (F.col("n_outside") > 0) | ((F.col("n_null") > 0) & ~F.col("variable").isin(*nullable))
    return out.withColumn("status", F.when(bad, "FAIL").otherwise("PASS"))


def frequency_contract(df: DataFrame, code: str, expected: DataFrame) -> DataFrame:
    """(code, observed, expected, matches): counts against an expected (code, expected) table."""
    got = df.groupBy(F.col(code).alias("code")).agg(F.count("*").alias("observed"))
    out = got.join(expected, "code", "full").select("code", F.coalesce("observed", F.lit(0)).alias("observed"), F.coalesce("expected", F.lit(0)).alias("expected"))
    return out.withColumn("matches", F.col("observed") == F.col("expected"))


def role_contract(df: DataFrame, year: str, role: str, w: str, dev: str, frozen: int) -> DataFrame:
    """(year, roles, bad_dev, status): one role a year; the development weight is w/2, null in the frozen year."""
    bad = F.when(F.col(year) == frozen, F.col(dev).isNotNull()).otherwise(F.col(dev).isNull() | (F.abs(F.col(dev) - F.col(w) / 2) >= 1e-9))
    out = df.groupBy(year).agg(F.array_join(F.sort_array(F.collect_set(role)), ",").alias("roles"), F.count_distinct(role).alias("n_roles"), F.count_if(bad).alias("bad_dev"))
    return out.withColumn("status", F.when((F.col("n_roles") == 1) & (F.col("bad_dev") == 0), "PASS").otherwise("FAIL"))


def columns_check(df: DataFrame, required: list[str]) -> DataFrame:
    """(column, times, status) of each required column."""
    rows = [(c, df.columns.count(c), "PASS" if df.columns.count(c) == 1 else "FAIL") for c in required]
    return df.sparkSession.createDataFrame(rows, "column string, times int, status string")


def cohort_digest(df: DataFrame, keys: list[str]) -> DataFrame:
    """(n, digest): a fingerprint of the rows' keys that does not depend on their order.

    The digest is the sum over rows of the first 60 bits of the SHA-256 of the keys, so that repeated rows count
    (they would cancel in an exclusive or).  A key is its length and text, so that no two rows of keys read alike;
    a null is a key of its own.  No rows sum to 0.
    """
    text = [F.col(k).cast("string") for k in keys]
    parts = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]
    bits = F.conv(F.substring(F.sha2(F.concat(*parts), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(bits), F.lit(0)).cast("decimal(38,0)").cast("string").alias("digest"))
