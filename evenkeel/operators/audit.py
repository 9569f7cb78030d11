"""Descriptive and weighted audits: a few scans, then small joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import by_attr, ratio, unpivot
from ..functions.quantiles import with_quantiles
from ..sources.tabular import materialize
from .metrics import kish
from .recode import positive_weight


def survey_design_audit(df: DataFrame, year: str, w: str, stratum: str, psu: str) -> DataFrame:
    """(year) weights that are missing, odd or not positive; missing and distinct design values; eligibility."""
    raw, x = F.col(w).cast("string"), F.col(w).cast("string").try_cast("double")
    out = df.groupBy(year).agg(
        F.count("*").alias("n"),
        F.count_if(raw.isNotNull() & x.isNull()).alias("w_nonnumeric"),
        F.count_if(F.isnan(x) | (F.abs(x) == float("inf"))).alias("w_nonfinite"),
        F.count_if(raw.isNull()).alias("w_missing"),
        F.count_if(x <= 0).alias("w_nonpositive"),
        F.count_if(F.col(stratum).isNull()).alias("stratum_missing"),
        F.count_if(F.col(psu).isNull()).alias("psu_missing"),
        F.count_distinct(stratum).alias("strata"),
        F.count_distinct(stratum, psu).alias("psus"),
        F.sum(x).alias("w_sum"),
        F.min(x).alias("w_min"),
        F.max(x).alias("w_max"),
    )
    out = with_quantiles(out, df, [year], x, [0.5], ["w_median"])
    bad = F.col("w_nonnumeric") + F.col("w_nonfinite") + F.col("w_missing") + F.col("w_nonpositive") > 0
    eligible = ~bad & (F.col("stratum_missing") + F.col("psu_missing") == 0)
    return out.withColumn("status", F.when(bad, "FAIL").otherwise("PASS")).withColumn("inference_eligible", eligible)


def weighted_share(hit: Column, among: Column, w: str) -> Column:
    """Weight of ``hit`` over weight of ``among``, positive weights only: null if empty, 0 without a hit."""
    ok = positive_weight(F.col(w)) & among
    return ratio(F.sum(F.when(ok & hit, F.col(w)).when(ok, 0.0)), F.sum(F.when(ok, F.col(w))))


def outcome_audit(df: DataFrame, year: str, outcomes: dict[str, list[int]], w: str) -> DataFrame:
    """(year, outcome, code) n, share and weighted share; code null collects what is invalid or missing."""
    long = unpivot(df, list(outcomes), "outcome", "code", [year, w])
    good = F.lit(False)
    for name, codes in outcomes.items():
        good = good | ((F.col("outcome") == name) & F.col("code").isin([str(c) for c in codes]))
    long = long.withColumn("code", F.when(good, F.col("code")))
    got = long.groupBy(year, "outcome", "code").agg(F.count("*").alias("n"), F.sum(F.when(positive_weight(F.col(w)), F.col(w))).alias("sw"))
    total = got.groupBy(year, "outcome").agg(F.sum("n").alias("all_n"), F.sum("sw").alias("all_w"))
    codes = [(name, str(c)) for name, cs in outcomes.items() for c in cs] + [(name, None) for name in outcomes]
    dims = df.sparkSession.createDataFrame(codes, "outcome string, code string")
    every = total.join(F.broadcast(dims), "outcome")  # a row per declared code
    a, b = every.alias("a"), got.alias("b")
    on = (F.col(f"a.{year}") == F.col(f"b.{year}")) & (F.col("a.outcome") == F.col("b.outcome")) & F.col("a.code").eqNullSafe(F.col("b.code"))
    n, sw = F.coalesce("b.n", F.lit(0)), F.coalesce("b.sw", F.lit(0.0))
    return a.join(b, on, "left").select(f"a.{year}", "a.outcome", "a.code", n.alias("n"), ratio(n, F.col("all_n")).alias("share"), ratio(sw, F.col("all_w")).alias("weighted_share"))


def protected_audit(df: DataFrame, year: str, attrs: list[str], w: str) -> DataFrame:
    """(year, attr, grp) n and weighted population share; grp null is the missing bucket."""
    got = by_attr(df, attrs, [year, w]).groupBy(year, "attr", "grp").agg(F.count("*").alias("n"), F.sum(F.when(positive_weight(F.col(w)), F.col(w))).alias("sw"))
    total = got.groupBy(year, "attr").agg(F.sum("sw").alias("all_w"))
    return got.join(total, [year, "attr"]).select(year, "attr", "grp", "n", ratio(F.coalesce("sw", F.lit(0.0)), F.col("all_w")).alias("weighted_share"))


def feature_availability(headers: DataFrame, features: list[str], years: list[int]) -> DataFrame:
    """(feature, year, present, status); ``headers`` is (feature, year) of what the files hold."""
    spark = headers.sparkSession
    grid = spark.createDataFrame([(f, y) for f in features for y in years], "feature string, year int")
    out = grid.join(headers.select("feature", "year").distinct().withColumn("present", F.lit(True)), ["feature", "year"], "left")
    out = out.withColumn("present", F.coalesce("present", F.lit(False)))
    full = out.groupBy("feature").agg(F.min("present").alias("always"))
    return out.join(full, "feature").select("feature", "year", "present", F.when(F.col("always"), "COMPATIBLE").otherwise("INCOMPLETE").alias("status"))


def feature_code_domain(df: DataFrame, year: str, domains: dict[str, list[int]]) -> DataFrame:
    """(feature, year) observed and expected range, and the codes that were not expected."""
    got = unpivot(df, list(domains), "feature", "v", [year]).filter(F.col("v").isNotNull()).groupBy("feature", year, F.col("v").cast("int").alias("v")).agg(F.count("*").alias("n"))
    spark = df.sparkSession
    want = spark.createDataFrame([(f, min(c), max(c)) for f, c in domains.items()], "feature string, want_min int, want_max int")
    known = spark.createDataFrame([(f, v, True) for f, c in domains.items() for v in c], "feature string, v int, known boolean")
    # only codes that are not expected are gathered
    odd = F.collect_list(F.when(F.col("known").isNull(), F.col("v")))
    seen = got.join(F.broadcast(known), ["feature", "v"], "left").groupBy("feature", year).agg(F.min("v").alias("seen_min"), F.max("v").alias("seen_max"), odd.alias("odd"))
    text = F.array_join(F.array_sort("odd").cast("array<string>"), ",").alias("unexpected")
    return seen.join(F.broadcast(want), "feature").select("feature", year, "seen_min", "seen_max", "want_min", "want_max", text)


def feature_missingness(df: DataFrame, year: str, features: list[str], w: str) -> DataFrame:
    """(feature, year) missing n, fraction and weighted fraction."""
    long = unpivot(df, features, "feature", "v", [year, w])
    gone = F.col("v").isNull()
    return long.groupBy("feature", year).agg(
        F.count_if(gone).alias("n_missing"),
        ratio(F.count_if(gone), F.count("*")).alias("fraction"),
        ratio(F.sum(F.when(gone, F.col(w)).otherwise(0.0)), F.sum(w)).alias("weighted_fraction"),
    )


def category_distribution(df: DataFrame, features: list[str], w: str, keys: list[str] = ()) -> DataFrame:
    """(keys, feature, code) n and weighted share; code null is missing."""
    got = unpivot(df, features, "feature", "code", [*keys, w]).groupBy(*keys, "feature", "code").agg(F.count("*").alias("n"), F.sum(w).alias("sw"))
    total = got.groupBy(*keys, "feature").agg(F.sum("sw").alias("all_w"))
    return got.join(total, [*keys, "feature"]).select(*keys, "feature", "code", "n", ratio(F.col("sw"), F.col("all_w")).alias("weighted_share"))


def numeric_distribution(df: DataFrame, features: list[str], w: str) -> DataFrame:
    """(feature) n, mean, std, min, quartiles, max, weighted mean."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])
    long = df.select(F.col(w).alias("w"), F.inline(pairs))
    seen = F.when(F.col("v").isNotNull(), F.col("w"))
    out = long.groupBy("feature").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"),
        ratio(F.sum(F.col("v") * F.col("w")), F.sum(seen)).alias("weighted_mean"),
    )
    out = with_quantiles(out, long, ["feature"], F.col("v"), [0.25, 0.5, 0.75], ["p25", "median", "p75"])
    return out.select("feature", "n", "mean", "std", "min", "p25", "median", "p75", "max", "weighted_mean")


def leakage_guard(features: DataFrame, forbidden: DataFrame) -> DataFrame:
    """(feature) of the list that are forbidden or protected."""
    return features.join(forbidden, "feature", "left_semi")


def missingness_states(df: DataFrame, state: Column, w: str, keys: list[str] = ()) -> DataFrame:
    """(keys, state) n, weight, fraction, weighted fraction and whether the states add up to the rows."""
    got = df.select(*keys, w, state.alias("state")).groupBy(*keys, "state").agg(F.count("*").alias("n"), F.sum(w).alias("weight"))
    total = got.groupBy(*keys).agg(F.sum("n").alias("all_n"), F.sum("weight").alias("all_w"))
    rows = df.groupBy(*keys).agg(F.count("*").alias("rows"))
    total = total.join(rows, list(keys)) if keys else total.crossJoin(F.broadcast(rows))  # one row
    got = got.join(total, list(keys)) if keys else got.crossJoin(F.broadcast(total))
    return got.select(*keys, "state", "n", "weight", ratio(F.col("n"), F.col("all_n")).alias("fraction"), ratio(F.col("weight"), F.col("all_w")).alias("weighted_fraction"), (F.col("all_n") == F.col("rows")).alias("reconciled"))


def omitted_codes(df: DataFrame, documented: DataFrame, registered: DataFrame) -> DataFrame:
    """(variable, code, n): counts of documented codes that the registry leaves out."""
    out = documented.join(registered, ["variable", "code"], "left_anti")
    names = [r.variable for r in documented.select("variable").distinct().collect()]  # of the registry
    got = unpivot(df, sorted(names), "variable", "code", []).groupBy("variable", "code").agg(F.count("*").alias("n"))
    return out.join(got, ["variable", "code"], "left").select("variable", "code", F.coalesce("n", F.lit(0)).alias("n"))


def variable_eligibility(meta: DataFrame, years: int) -> DataFrame:
    """(variable) class and reason from (variable, year, excluded_by): excluded, unresolved, or eligible for review."""
    got = meta.groupBy("variable").agg(F.count_distinct("year").alias("years"), F.max("excluded_by").alias("rule"))
    kind = F.when(F.col("rule").isNotNull(), "EXCLUDED").when(F.col("years") < years, "UNRESOLVED").otherwise("ELIGIBLE_FOR_REVIEW")
    why = F.when(F.col("rule").isNotNull(), F.col("rule")).when(F.col("years") < years, "absent in a year").otherwise("none")
    return got.select("variable", "years", kind.alias("status"), why.alias("reason"))


def eligibility_summary(df: DataFrame, year: str, y_ok: Column, a_ok: Column, w: str) -> DataFrame:
    """(year, reason) n, weight and share of the year's rows; year null is the total."""
    reason = F.when(y_ok & a_ok, "joint").when(~y_ok & ~a_ok, "both").when(~y_ok, "onlyY").otherwise("onlyA")
    rows = df.select(year, w, reason.alias("reason")).groupBy(year, "reason").agg(F.count("*").alias("n"), F.sum(w).alias("weight"))
    every = rows.unionByName(rows.groupBy("reason").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).withColumn(year, F.lit(None).cast("int")))
    total = every.groupBy(year).agg(F.sum("n").alias("all_n"))
    a, b = every.alias("a"), total.alias("b")
    return a.join(b, F.col(f"a.{year}").eqNullSafe(F.col(f"b.{year}"))).select(f"a.{year}", "reason", "n", "weight", ratio(F.col("n"), F.col("all_n")).alias("share"))


def weight_diagnostics(df: DataFrame, part: str, grp: str, w: str) -> DataFrame:
    """(part, grp) and (part): n, sum, min, median, max, distinct and non-positive weights; grp null is the part.

    Rows are counted by weight once, so that what follows grows with the distinct weights of a group.
    """
    cells = materialize(df.groupBy(part, grp, F.col(w).alias("_v")).agg(F.count("*").alias("_n")), "weights")
    both = cells.select(part, grp, "_v", "_n", F.explode(F.array(F.lit(0).cast("tinyint"), F.lit(1).cast("tinyint"))).alias("_whole"))  # each cell in its group and in its part
    both = both.withColumn(grp, F.when(F.col("_whole") == 0, F.col(grp))).groupBy(part, grp, "_whole", "_v").agg(F.sum("_n").alias("_n"))
    both = materialize(both, "weights")
    out = both.groupBy(part, grp, "_whole").agg(
        F.sum("_n").alias("n"), F.sum(F.col("_v") * F.col("_n")).alias("w_sum"), F.min("_v").alias("w_min"), F.max("_v").alias("w_max"),
        F.count("_v").alias("w_distinct"), F.coalesce(F.sum(F.when(F.col("_v") <= 0, F.col("_n"))), F.lit(0)).alias("w_nonpositive"),
    )
    out = with_quantiles(out, both, [part, grp, "_whole"], F.col("_v"), [0.5], ["w_median"], F.col("_n")).drop("_whole")
    return out.withColumn("status", F.when(F.col("w_nonpositive") == 0, "PASS").otherwise("FAIL"))


def cohort_summary(df: DataFrame, grp: str, y: str, w: str) -> DataFrame:
    """Overall (grp null) and per group: n, events, weight, weighted event rate, effective size, status."""
    out = df.rollup(grp).agg(
        F.count("*").alias("n"), F.sum(y).alias("events"), F.sum(w).alias("weight"), ratio(F.sum(F.col(w) * F.col(y)), F.sum(w)).alias("event_rate"), kish(F.col(w)).alias("ess")
    )
    status = F.when(F.col("events") == 0, "NO_EVENT").when(F.col("events") == F.col("n"), "ALL_EVENTS").otherwise("VALID")
    return out.withColumn("status", status)


def design_coverage(df: DataFrame, stratum: str, psu: str, in_domain: Column) -> DataFrame:
    """(scope) strata, PSUs and PSUs a stratum, of the full design and of the domain."""
    clusters = df.groupBy(stratum, psu).agg(F.max(in_domain.cast("int")).alias("d"))
    strata = clusters.groupBy(stratum).agg(F.count("*").alias("full"), F.sum("d").alias("domain"))
    pair = F.array(*[F.struct(F.lit(s).alias("scope"), F.col(s).cast("long").alias("n")) for s in ("full", "domain")])
    return strata.select(F.inline(pair)).filter("n > 0").groupBy("scope").agg(F.count("*").alias("strata"), F.sum("n").alias("psus"), F.min("n").alias("least"), F.max("n").alias("most"))


def semantic_missingness(df: DataFrame, features: list[str], vocabulary: DataFrame) -> DataFrame:
    """(feature) nulls, sentinels -1 and -2, and values outside the fitted (feature, level) vocabulary."""
    got = unpivot(df, features, "feature", "level", []).groupBy("feature", "level").agg(F.count("*").alias("n"))
    got = got.join(vocabulary.withColumn("known", F.lit(True)), ["feature", "level"], "left")
    n, level = F.col("n"), F.col("level")

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(F.when(c, n)), F.lit(0))

    unknown = level.isNotNull() & ~level.isin("-1", "-2") & F.col("known").isNull()
    return got.groupBy("feature").agg(total(level.isNull()).alias("n_null"), total(level == "-1").alias("n_niu"), total(level == "-2").alias("n_explicit"), total(unknown).alias("n_unknown"))


def cohort_table(df: DataFrame, keys: list[str], y: str, w: str, stratum: str, psu: str) -> DataFrame:
    """(keys) n, events, weighted rate, effective size, weight quantiles, strata and PSUs."""
    out = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(y).alias("events"), ratio(F.sum(F.col(w) * F.col(y)), F.sum(w)).alias("event_rate"), kish(F.col(w)).alias("ess"),
        F.count_distinct(stratum).alias("strata"), F.count_distinct(stratum, psu).alias("psus"),
    )
    return with_quantiles(out, df, keys, F.col(w), [0.25, 0.5, 0.75], ["w_p25", "w_p50", "w_p75"])


def distribution_summary(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """(keys) n, mean, std, five quantiles, their middle range and the share of 0.5 or more."""
    out = df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), ratio(F.count_if(F.col(x) >= 0.5), F.count(x)).alias("share_half"))
    out = with_quantiles(out, df, keys, F.col(x), [0.1, 0.25, 0.5, 0.75, 0.9], ["p10", "p25", "p50", "p75", "p90"])
    return out.withColumn("iqr", F.col("p75") - F.col("p25"))
