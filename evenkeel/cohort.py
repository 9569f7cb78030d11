"""Role-tagged cohorts: one DataFrame plus the names of its columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import ratio


@dataclass(frozen=True)
class Cohort:
    """Which column plays which role; row alignment is that of one DataFrame."""

    y: str = "y"
    attrs: tuple[str, ...] = ("seg", "bal_hi")
    weight: str = "w"
    stratum: str = "stratum"
    psu: str = "psu"
    key: str = "record_key"
    score: str = "p1"
    pred: str = "yhat"


DEFAULT = Cohort()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mean_discounts(lines: DataFrame) -> DataFrame:
    """(o_orderkey, n_lines, avg_disc): the mean of an order's discounts, the same double in any order of the lines.

    Whole millionths are summed as integers, so that the mean of discounts of up to six decimals is exact but for one
    rounding.  What a discount has beyond them is added in ascending order, as is all of one that is not finite or
    from a million on; only orders with such discounts are in that second sum.
    """
    x = F.col("l_discount").cast("double")
    units = F.when(F.abs(x) < 1e6, F.round(x * 1e6)).when(x.isNotNull(), 0.0).cast("bigint")
    lines = lines.select(F.col("l_orderkey").alias("o_orderkey"), units.alias("u"), (x - units / 1e6).alias("r"))
    finer = lines.filter("r <> 0").groupBy(F.col("o_orderkey").alias("_k")).agg(F.sort_array(F.collect_list("r")).alias("_r"))
    finer = finer.select("_k", F.aggregate("_r", F.lit(0.0), lambda a, r: a + r).alias("_r"))
    sums = lines.groupBy("o_orderkey").agg(F.count("*").alias("n_lines"), F.count("u").alias("_n"), F.sum("u").alias("_u"))
    mean = ratio(F.col("_u"), 1_000_000 * F.col("_n")) + ratio(F.coalesce("_r", F.lit(0.0)), F.col("_n"))
    return sums.join(finer, F.col("o_orderkey") == F.col("_k"), "left").select("o_orderkey", "n_lines", mean.alias("avg_disc"))


def order_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived survey cohort: one row per order."""
    lines = mean_discounts(table(spark, sf_dir, "lineitem"))
    customer = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    df = (
        table(spark, sf_dir, "orders")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(lines, "o_orderkey", "left")
    )
    mix = (F.col("o_orderkey") * 7919 + F.col("o_custkey") * 104729) % 1000
    return df.select(
        F.col("o_orderkey").alias("record_key"),
        F.year("o_orderdate").alias("survey_year"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"),
        F.col("c_mktsegment").alias("seg"),
        F.when(F.col("c_acctbal") > 5000, 1).otherwise(0).alias("bal_hi"),
        (F.col("o_totalprice") / 1000).alias("w"),
        F.col("n_regionkey").alias("stratum"),
        F.col("c_nationkey").alias("psu"),
        F.col("o_orderpriority").alias("prio"),
        F.col("o_totalprice").alias("price"),
        F.col("c_acctbal").alias("acctbal"),
        "n_lines",
        "avg_disc",
        (mix / 1000).alias("p1"),
        (((F.col("o_orderkey") * 31 + F.col("c_nationkey") * 17) % 100) / 100).alias("p2"),
        (mix >= 500).cast("int").alias("yhat"),
    )


def coded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coded survey frame: 1 yes, 2 no, 3-6 other substantive codes, 7 missing."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.year("l_shipdate").alias("survey_year"),
        F.col("l_linenumber").alias("code"),
        F.col("l_returnflag").alias("route"),
        F.col("l_linestatus").alias("prot"),
        F.col("l_quantity").alias("w"),
        F.col("l_orderkey").alias("orderkey"),
    )
