"""Splits by hashes of (seed, key): the same on every run and layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import all_of

MODULUS = 1_000_003


def hash_uniform(key: Column, seed: int) -> Column:
    """Arithmetic hash in [0, 1), shared with SQL engines."""
    return ((key * 7919 + F.lit(seed) * 104729) % MODULUS) / MODULUS


def hash_rank(df: DataFrame, strata: list[str], key: str, seed: int, ranges: int = 256) -> DataFrame:
    """Adds ``rank`` (from 1, by hash then key) and ``size`` in each stratum.

    Two levels, so that a stratum of any size is ranked by many tasks: row numbers inside ranges of the
    hash, plus the counts of the ranges before (at most ``ranges`` a stratum).
    """
    rows = df.withColumn("_u", hash_uniform(F.col(key), seed)).withColumn("_r", F.floor(F.col("_u") * ranges).cast("int"))
    counts = rows.groupBy(*strata, "_r").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*strata).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*strata, "_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"), F.sum("_n").over(Window.partitionBy(*strata)).alias("size"))
    inner = Window.partitionBy(*strata, "_r").orderBy("_u", key)
    a, b = rows.withColumn("_i", F.row_number().over(inner)).alias("a"), counts.alias("b")
    on = all_of([F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*strata, "_r"]])
    return a.join(b, on).select(*[F.col(f"a.{c}").alias(c) for c in df.columns], (F.col("_i") + F.col("_o")).alias("rank"), "size")


def stratified_split(df: DataFrame, strata: list[str], key: str, seed: int = 0, train: float = 0.64, val: float = 0.16) -> DataFrame:
    """Adds ``split``: in each stratum round(n * train) rows train, round(n * val) val, the rest test."""
    ranked = hash_rank(df, strata, key, seed)
    a, b = F.round(F.col("size") * train), F.round(F.col("size") * val)
    return ranked.withColumn("split", F.when(F.col("rank") <= a, "train").when(F.col("rank") <= a + b, "val").otherwise("test")).drop("rank", "size")


def split_audit(df: DataFrame, strata: list[str], train: float = 0.64, val: float = 0.16, tolerance: float = 0.02) -> DataFrame:
    """(strata) counts per split, the largest distance from its target, status."""
    share = {"train": train, "val": val, "test": 1 - train - val}
    out = df.groupBy(*strata).agg(F.count("*").alias("n"), *[F.count_if(F.col("split") == s).alias(s) for s in share])
    worst = F.greatest(*[F.abs(F.col(s) / F.col("n") - t) for s, t in share.items()])
    whole = F.col("train") + F.col("val") + F.col("test") == F.col("n")
    return out.withColumn("worst", worst).withColumn("status", F.when(whole & (worst <= tolerance), "PASS").otherwise("FAIL"))


def cluster_roles(df: DataFrame, stratum: str, psu: str, seed: int, share: float = 0.2) -> DataFrame:
    """(stratum, psu, cluster_role): whole clusters to calibration or fitting."""
    u = hash_uniform(F.col(stratum) * 1000 + F.col(psu), seed)
    return df.select(stratum, psu).distinct().withColumn("cluster_role", F.when(u < share, "calibration").otherwise("fitting"))


def role_partition(df: DataFrame, roles: DataFrame, year: str, stratum: str, psu: str, fit_years: list[int], select_year: int) -> DataFrame:
    """Adds ``role``: F or C by cluster in the fit years, S in the selection year, T after it."""
    out = df.join(roles, [stratum, psu], "left")
    fit = F.when(F.col("cluster_role") == "calibration", "C").otherwise("F")
    return out.withColumn("role", F.when(F.col(year).isin(fit_years), fit).when(F.col(year) == select_year, "S").when(F.col(year) > select_year, "T"))


def partition_disjoint(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(shared, repeated_a, repeated_b, status)."""
    shared = a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("shared"))

    def repeated(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(key).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias(name))

    out = shared.crossJoin(repeated(a, "repeated_a")).crossJoin(repeated(b, "repeated_b"))  # one row each
    clean = (F.col("shared") == 0) & (F.col("repeated_a") == 0) & (F.col("repeated_b") == 0)
    return out.withColumn("status", F.when(clean, "PASS").otherwise("FAIL"))
