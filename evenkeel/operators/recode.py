"""Row-level recodes: expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_code(c: Column) -> Column:
    """Integral numeric value as a long, else null."""
    x = c.try_cast("double")
    return F.when(x == F.round(x), x.try_cast("long"))


def _undeclared(c: Column, otherwise: Column, declared: list[int]) -> Column:
    bad = c.isNotNull() & ~c.isin(declared)
    return F.when(bad, F.raise_error(F.concat(F.lit("undeclared code "), c.cast("string")))).otherwise(otherwise)


def recode_binary(c: Column, missing: list[int]) -> Column:
    """1 -> 1, 2 -> 0, declared missing or null -> null; anything else is an error."""
    return _undeclared(c, F.when(c == 1, 1).when(c == 2, 0).cast("int"), [1, 2, *missing])


def recode_categorical(c: Column, keep: list[int], missing: list[int]) -> Column:
    """Substantive codes stay, missing ones become null; undeclared ones are an error."""
    return _undeclared(c, F.when(c.isin(keep), c).cast("int"), [*keep, *missing])


def recode_predictor(c: Column, registry: dict[str, list[int]]) -> Column:
    """As ``recode_categorical`` by a registry entry {"valid_codes", "missing_codes"}; raw null stays null."""
    return recode_categorical(c, registry["valid_codes"], registry.get("missing_codes", []))


def parse_weight(c: Column) -> Column:
    """Double; text that is not a number is an error."""
    x = c.try_cast("double")
    return F.when(c.isNotNull() & x.isNull(), F.raise_error(F.lit("a weight is not numeric")).cast("double")).otherwise(x)


def dev_weight(w: Column, year: Column, years: list[int]) -> Column:
    return F.when(year.isin(years), w / 2)


def routed_state(route: Column, asked: list[str], code: Column, yes: int, no: int) -> Column:
    """1 or 2 where the question was asked and answered, -1 where it was not asked, -2 where the answer is missing."""
    return F.when(~F.coalesce(route.isin(asked), F.lit(False)), -1).when(code == yes, 1).when(code == no, 2).otherwise(-2)


def outcome_state(y: Column) -> Column:
    return F.when(y == 0, "0").when(y == 1, "1").otherwise("missing_or_non_substantive")


def positive_weight(w: Column) -> Column:
    return w.isNotNull() & ~F.isnan(w) & (w > 0) & (F.abs(w) < float("inf"))


def record_key(*parts: Column) -> Column:
    return F.concat_ws(":", *parts)


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of blank or repeated keys."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | F.col(key).isNull() | (F.trim(F.col(key)) == ""))


def harmonize_year(df: DataFrame, year: int, role: str, dev_years: list[int], missing: list[int]) -> DataFrame:
    """One year of the coded frame: role, raw alias, recoded outcome, protected value and development weight."""
    code = F.when(F.col("code") >= 3, 9).otherwise(F.col("code"))
    return df.filter(F.col("survey_year") == year).select(
        record_key(F.lit("lines"), F.col("survey_year"), F.col("id")).alias("record_key"),
        "survey_year",
        F.lit(role).alias("role"),
        F.col("code").alias("code_raw"),
        recode_binary(code, missing).alias("y"),
        F.when(F.col("prot").isin("F", "O"), F.col("prot")).alias("prot"),
        "w",
        dev_weight(F.col("w"), F.col("survey_year"), dev_years).alias("w_dev"),
    )


def union_years(frames: dict[int, DataFrame], years: list[int]) -> DataFrame:
    """The requested years; a missing one is an error."""
    if absent := [y for y in years if y not in frames]:
        raise ValueError(f"no frame for {absent}")
    return reduce(DataFrame.unionByName, [frames[y] for y in years])


def cohort_filter(df: DataFrame, y: str, attr: str) -> DataFrame:
    """Rows with an outcome and a protected value; neither is ever imputed."""
    return df.filter(F.col(y).isNotNull() & F.col(attr).isNotNull())


def domain_mask(df: DataFrame, y: str, attr: str, valid: list[Column]) -> DataFrame:
    """The same test as a flag on the full design, with every method's validity."""
    flag = reduce(lambda a, b: a & b, valid, F.col(y).isNotNull() & F.col(attr).isNotNull())
    return df.withColumn("in_domain", F.coalesce(flag, F.lit(False)))


def expand_domain(design: DataFrame, values: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Domain values on all rows of the design, 0 outside."""
    out = design.join(values.select(key, *cols), key, "left")
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols})
