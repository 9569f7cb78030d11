"""Weighted audits of the coded frame and the cohort."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cohort import coded_lines, order_cohort, table
from ..functions.columns import rounded
from ..operators import audit as A
from ..operators.metrics import kish
from .contract_queries import _masked, _MASKED
from .registry import CODED, COHORT, LONG, query


@query(
    f"""WITH {CODED} SELECT survey_year, count(*) AS n, CAST(0 AS BIGINT) AS w_nonnumeric, CAST(0 AS BIGINT) AS w_nonfinite, count(*) FILTER (w IS NULL) AS w_missing,
 count(*) FILTER (w <= 0) AS w_nonpositive, count(*) FILTER (route IS NULL) AS stratum_missing, count(*) FILTER (prot IS NULL) AS psu_missing, count(DISTINCT route) AS strata,
 count(DISTINCT route || prot) AS psus, round(sum(w), 6) AS w_sum, min(w) AS w_min, quantile_cont(w, 0.5) AS w_median, max(w) AS w_max, 'PASS' AS status, true AS inference_eligible FROM coded GROUP BY survey_year"""
)
def survey_design_audit(spark, sf):
    return rounded(A.survey_design_audit(coded_lines(spark, sf), "survey_year", "w", "route", "prot"))


@query(f"WITH {CODED} SELECT survey_year, round(sum(CASE WHEN code = 1 THEN w ELSE 0 END) / sum(w), 6) AS p FROM coded WHERE code IN (1, 2) AND w > 0 GROUP BY survey_year")
def weighted_binary_proportion(spark, sf):
    share = A.weighted_share(F.col("code") == 1, F.col("code").isin(1, 2), "w").alias("p")
    return rounded(coded_lines(spark, sf).groupBy("survey_year").agg(share))


@query(
    f"""WITH {CODED} SELECT survey_year, round(sum(CASE WHEN code = 3 THEN w ELSE 0 END) / sum(w), 6) AS p3, round(sum(CASE WHEN code > 6 THEN w ELSE 0 END) / sum(w), 6) AS invalid
 FROM coded WHERE w > 0 GROUP BY survey_year"""
)
def weighted_category_proportion(spark, sf):
    yes = F.lit(True)
    return rounded(
        coded_lines(spark, sf).groupBy("survey_year").agg(A.weighted_share(F.col("code") == 3, yes, "w").alias("p3"), A.weighted_share(F.col("code") > 6, yes, "w").alias("invalid"))
    )


_OUT = {"code": [1, 2, 9], "line": [1, 2, 3, 4]}
_OUTCOMES = """lo AS (SELECT survey_year, w, 'code' AS outcome, CASE WHEN code IN (1, 2, 9) THEN CAST(code AS VARCHAR) END AS code FROM coded
 UNION ALL SELECT survey_year, w, 'line', CASE WHEN code IN (1, 2, 3, 4) THEN CAST(code AS VARCHAR) END FROM coded),
t AS (SELECT survey_year, outcome, count(*) AS an, sum(w) AS aw FROM lo GROUP BY 1, 2),
d AS (SELECT * FROM (VALUES ('code', '1'), ('code', '2'), ('code', '9'), ('code', NULL), ('line', '1'), ('line', '2'), ('line', '3'), ('line', '4'), ('line', NULL)) v(outcome, code)),
oa AS (SELECT t.survey_year, d.outcome, d.code, count(lo.w) AS n, round(count(lo.w) / any_value(an), 6) AS share, round(coalesce(sum(lo.w), 0) / any_value(aw), 6) AS weighted_share
 FROM t JOIN d USING (outcome) LEFT JOIN lo ON lo.survey_year = t.survey_year AND lo.outcome = d.outcome AND lo.code IS NOT DISTINCT FROM d.code GROUP BY 1, 2, 3)"""


def _outcomes(spark, sf):
    return rounded(A.outcome_audit(coded_lines(spark, sf).withColumn("line", F.col("code")), "survey_year", _OUT, "w"))


@query(f"WITH {CODED}, {_OUTCOMES} SELECT * FROM oa")
def outcome_audit(spark, sf):
    return _outcomes(spark, sf)


_PROT = """lp AS (SELECT survey_year, w, 'route' AS attr, route AS grp FROM coded UNION ALL SELECT survey_year, w, 'prot', CASE WHEN code < 7 THEN prot END FROM coded),
pa AS (SELECT survey_year, attr, grp, count(*) AS n, round(sum(w) / (SELECT sum(w) FROM lp x WHERE x.survey_year = lp.survey_year AND x.attr = lp.attr), 6) AS weighted_share FROM lp GROUP BY 1, 2, 3)"""


def _protected(spark, sf):
    df = coded_lines(spark, sf).withColumn("prot", F.when(F.col("code") < 7, F.col("prot")))
    return rounded(A.protected_audit(df, "survey_year", ["route", "prot"], "w"))


@query(f"WITH {CODED}, {_PROT} SELECT * FROM pa")
def protected_audit(spark, sf):
    return _protected(spark, sf)


@query(
    f"""WITH {CODED}, {_OUTCOMES}, {_PROT} SELECT 'outcome' AS audit, survey_year, outcome AS variable, code AS level, n, weighted_share FROM oa
 UNION ALL SELECT 'protected', survey_year, attr, grp, n, weighted_share FROM pa
 UNION ALL SELECT 'design', survey_year, 'w', NULL, count(*), 1.0 FROM coded GROUP BY survey_year"""
)
def audit_tables(spark, sf):
    a = _outcomes(spark, sf).select(F.lit("outcome").alias("audit"), "survey_year", F.col("outcome").alias("variable"), F.col("code").alias("level"), "n", "weighted_share")
    b = _protected(spark, sf).select(F.lit("protected").alias("audit"), "survey_year", F.col("attr").alias("variable"), F.col("grp").alias("level"), "n", "weighted_share")
    c = A.survey_design_audit(coded_lines(spark, sf), "survey_year", "w", "route", "prot")
    c = c.select(F.lit("design").alias("audit"), "survey_year", F.lit("w").alias("variable"), F.lit(None).cast("string").alias("level"), "n", F.lit(1.0).alias("weighted_share"))
    return a.unionByName(b).unionByName(c)


@query(
    f"""WITH {COHORT}, h AS (SELECT DISTINCT prio AS feature, survey_year AS year FROM cohort WHERE acctbal < -970), f AS (SELECT DISTINCT prio AS feature FROM cohort),
g AS (SELECT f.feature, CAST(y AS INT) AS year, h.feature IS NOT NULL AS present FROM f CROSS JOIN range(1995, 2002) r(y) LEFT JOIN h ON h.feature = f.feature AND h.year = y)
SELECT feature, year, present, CASE WHEN min(present) OVER (PARTITION BY feature) THEN 'COMPATIBLE' ELSE 'INCOMPLETE' END AS status FROM g"""
)
def feature_availability(spark, sf):
    heads = order_cohort(spark, sf).filter("acctbal < -970").select(F.col("prio").alias("feature"), F.col("survey_year").alias("year"))
    return A.feature_availability(heads, ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], list(range(1995, 2002)))


@query(
    f"""WITH {CODED}, v AS (SELECT survey_year, 'code' AS feature, code AS v FROM coded UNION ALL SELECT survey_year, 'qty', CAST(w AS INT) FROM coded),
w AS (SELECT * FROM (VALUES ('code', 1, 5), ('qty', 1, 48)) t(feature, want_min, want_max))
SELECT feature, survey_year, min(v) AS seen_min, max(v) AS seen_max, any_value(want_min) AS want_min, any_value(want_max) AS want_max,
 coalesce(string_agg(DISTINCT CASE WHEN v NOT BETWEEN want_min AND want_max THEN v END, ',' ORDER BY CASE WHEN v NOT BETWEEN want_min AND want_max THEN v END), '') AS unexpected
FROM v JOIN w USING (feature) GROUP BY feature, survey_year"""
)
def feature_code_domain(spark, sf):
    df = coded_lines(spark, sf).withColumn("qty", F.col("w").cast("int"))
    return A.feature_code_domain(df, "survey_year", {"code": list(range(1, 6)), "qty": list(range(1, 49))})


_FM = " UNION ALL ".join(f"SELECT '{f}' AS feature, survey_year, w, {f} IS NULL AS gone FROM masked" for f in ("y", "seg"))


@query(
    f"""WITH {_MASKED}, l AS ({_FM}) SELECT feature, survey_year, count(*) FILTER (gone) AS n_missing, round(count(*) FILTER (gone) / count(*), 6) AS fraction,
 round(sum(CASE WHEN gone THEN w ELSE 0 END) / sum(w), 6) AS weighted_fraction FROM l GROUP BY 1, 2"""
)
def feature_missingness(spark, sf):
    return rounded(A.feature_missingness(_masked(spark, sf), "survey_year", ["y", "seg"], "w"))


_CD = " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS VARCHAR) AS code, w FROM masked" for f in ("y", "seg"))


@query(f"WITH {_MASKED}, l AS ({_CD}) SELECT feature, code, count(*) AS n, round(sum(w) / sum(sum(w)) OVER (PARTITION BY feature), 6) AS weighted_share FROM l GROUP BY 1, 2")
def feature_distribution(spark, sf):
    return rounded(A.category_distribution(_masked(spark, sf), ["y", "seg"], "w"))


_ND = " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS v, w FROM cohort" for f in ("price", "acctbal", "avg_disc"))


@query(
    f"""WITH {COHORT}, l AS ({_ND}) SELECT feature, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(quantile_cont(v, 0.25), 6) AS p25,
 round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS p75, round(max(v), 6) AS max, round(sum(v * w) / sum(CASE WHEN v IS NOT NULL THEN w END), 6) AS weighted_mean FROM l GROUP BY feature"""
)
def feature_distribution_numeric(spark, sf):
    return rounded(A.numeric_distribution(order_cohort(spark, sf), ["price", "acctbal", "avg_disc"], "w"))


@query("SELECT DISTINCT p_brand AS feature FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size > 49)")
def leakage_guard(spark, sf):
    part = table(spark, sf, "part")
    return A.leakage_guard(part.select(F.col("p_brand").alias("feature")).distinct(), part.filter("p_size > 49").select(F.col("p_brand").alias("feature")))


_REG = {"code": [1, 2, 3], "route": [4, 5]}


@query(f"WITH {CODED}, r AS (SELECT * FROM (VALUES ('code', 1), ('code', 2), ('code', 3), ('route', 4), ('route', 5)) t(variable, code)) SELECT r.variable, r.code, count(coded.id) AS n FROM r LEFT JOIN coded USING (code) GROUP BY 1, 2")
def registry_audit(spark, sf):
    reg = spark.createDataFrame(list(_REG.items()), "variable string, codes array<int>").select("variable", F.explode("codes").alias("code"))
    got = coded_lines(spark, sf).groupBy("code").agg(F.count("*").alias("n"))
    return reg.join(got, "code", "left").select("variable", "code", F.coalesce("n", F.lit(0)).alias("n"))


_STATE = "CASE WHEN route = 'N' AND code > 5 THEN 'structural_niu' WHEN code IN (1, 2, 3) THEN 'observed' WHEN code = 7 THEN 'item_nonresponse' ELSE 'unknown_unmapped' END"


def _states():
    code = F.col("code")
    return (
        F.when((F.col("route") == "N") & (code > 5), "structural_niu").when(code.isNull(), "raw_null").when(code.isin(1, 2, 3), "observed")
        .when(code == 7, "item_nonresponse").otherwise("unknown_unmapped")
    )


@query(
    f"""WITH {CODED} SELECT {_STATE} AS state, count(*) AS n, sum(w) AS weight, round(count(*) / sum(count(*)) OVER (), 6) AS fraction, round(sum(w) / sum(sum(w)) OVER (), 6) AS weighted_fraction, true AS reconciled
 FROM coded GROUP BY 1"""
)
def missingness_states(spark, sf):
    return rounded(A.missingness_states(coded_lines(spark, sf), _states(), "w"))


@query(
    f"""WITH {CODED}, s AS (SELECT survey_year, prot, {_STATE} AS state, count(*) AS n, sum(w) AS weight FROM coded GROUP BY 1, 2, 3)
SELECT *, round(n / sum(n) OVER (PARTITION BY survey_year, prot), 6) AS fraction, round(weight / sum(weight) OVER (PARTITION BY survey_year, prot), 6) AS weighted_fraction, true AS reconciled FROM s"""
)
def missingness_by_partition(spark, sf):
    return rounded(A.missingness_states(coded_lines(spark, sf), _states(), "w", ["survey_year", "prot"]))


@query(
    f"""WITH {CODED}, d AS (SELECT 'code' AS variable, CAST(i AS VARCHAR) AS code FROM range(1, 10) r(i) WHERE i > 4)
SELECT variable, d.code, count(coded.id) AS n FROM d LEFT JOIN coded ON CAST(coded.code AS VARCHAR) = d.code GROUP BY 1, 2"""
)
def omitted_codes(spark, sf):
    doc = spark.createDataFrame([("code", str(i)) for i in range(1, 10)], "variable string, code string")
    return A.omitted_codes(coded_lines(spark, sf), doc, doc.filter("code <= '4'"))


@query(
    f"""WITH {COHORT}, m AS (SELECT 'n' || psu || '_' || CAST(round(p2 * 100) AS INT) AS variable, count(DISTINCT survey_year) AS years, max(CASE WHEN stratum = 2 THEN 'region rule' END) AS r FROM cohort GROUP BY 1)
SELECT variable, years, CASE WHEN r IS NOT NULL THEN 'EXCLUDED' WHEN years < 7 THEN 'UNRESOLVED' ELSE 'ELIGIBLE_FOR_REVIEW' END AS status,
 CASE WHEN r IS NOT NULL THEN r WHEN years < 7 THEN 'absent in a year' ELSE 'none' END AS reason FROM m"""
)
def variable_eligibility(spark, sf):
    df = order_cohort(spark, sf)
    rule = F.when(F.col("stratum") == 2, "region rule")
    meta = df.select(F.concat(F.lit("n"), F.col("psu"), F.lit("_"), F.round(F.col("p2") * 100).cast("int")).alias("variable"), F.col("survey_year").alias("year"), rule.alias("excluded_by"))
    return A.variable_eligibility(meta, 7)


@query(
    f"""WITH {_MASKED}, r AS (SELECT survey_year, w, CASE WHEN y IS NOT NULL AND seg IS NOT NULL THEN 'joint' WHEN y IS NULL AND seg IS NULL THEN 'both' WHEN y IS NULL THEN 'onlyY' ELSE 'onlyA' END AS reason FROM masked),
g AS (SELECT survey_year, reason, count(*) AS n, sum(w) AS weight FROM r GROUP BY GROUPING SETS ((survey_year, reason), (reason)))
SELECT survey_year, reason, n, round(weight, 6) AS weight, round(n / sum(n) OVER (PARTITION BY survey_year), 6) AS share FROM g"""
)
def eligibility_summary(spark, sf):
    return rounded(A.eligibility_summary(_masked(spark, sf), "survey_year", F.col("y").isNotNull(), F.col("seg").isNotNull(), "w"))


@query(
    f"""WITH {CODED} SELECT survey_year, prot, count(*) AS n, sum(w) AS w_sum, min(w) AS w_min, quantile_cont(w, 0.5) AS w_median, max(w) AS w_max, count(DISTINCT w) AS w_distinct,
 count(*) FILTER (w <= 0) AS w_nonpositive, CASE WHEN count(*) FILTER (w <= 0) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM coded GROUP BY GROUPING SETS ((survey_year), (survey_year, prot))"""
)
def weight_diagnostics(spark, sf):
    return rounded(A.weight_diagnostics(coded_lines(spark, sf), "survey_year", "prot", "w"))


@query(f"WITH {COHORT} SELECT seg, round(pow(sum(w), 2) / sum(w * w), 6) AS ess FROM cohort WHERE w > 0 GROUP BY seg")
def kish_ess(spark, sf):
    return rounded(order_cohort(spark, sf).groupBy("seg").agg(kish(F.col("w")).alias("ess")))


@query(
    f"""WITH {COHORT} SELECT seg, count(*) AS n, sum(y) AS events, round(sum(w), 6) AS weight, round(sum(w * y) / sum(w), 6) AS event_rate, round(pow(sum(w), 2) / sum(w * w), 6) AS ess,
 CASE WHEN sum(y) = 0 THEN 'NO_EVENT' WHEN sum(y) = count(*) THEN 'ALL_EVENTS' ELSE 'VALID' END AS status FROM cohort GROUP BY GROUPING SETS ((), (seg))"""
)
def cohort_summary(spark, sf):
    return rounded(A.cohort_summary(order_cohort(spark, sf), "seg", "y", "w"))


@query(
    f"""WITH {COHORT}, c AS (SELECT stratum, psu, max(CASE WHEN survey_year = 2000 AND p1 > 0.9 THEN 1 ELSE 0 END) AS d FROM cohort GROUP BY 1, 2),
s AS (SELECT stratum, count(*) AS f, sum(d) AS d FROM c GROUP BY 1), u AS (SELECT 'full' AS scope, f AS n FROM s UNION ALL SELECT 'domain', d FROM s WHERE d > 0)
SELECT scope, count(*) AS strata, sum(n) AS psus, min(n) AS least, max(n) AS most FROM u GROUP BY scope"""
)
def design_coverage(spark, sf):
    return A.design_coverage(order_cohort(spark, sf), "stratum", "psu", (F.col("survey_year") == 2000) & (F.col("p1") > 0.9))


@query(
    f"""WITH {CODED}, l AS (SELECT 'state' AS feature, CASE WHEN code = 7 THEN NULL WHEN route = 'N' THEN '-1' WHEN code > 4 THEN '-2' ELSE CAST(code AS VARCHAR) END AS level FROM coded)
SELECT feature, count(*) FILTER (level IS NULL) AS n_null, count(*) FILTER (level = '-1') AS n_niu, count(*) FILTER (level = '-2') AS n_explicit, count(*) FILTER (level IN ('3', '4')) AS n_unknown FROM l GROUP BY 1"""
)
def semantic_missingness(spark, sf):
    code = F.col("code")
    state = F.when(code == 7, None).when(F.col("route") == "N", -1).when(code > 4, -2).otherwise(code)
    vocab = spark.createDataFrame([("state", "1"), ("state", "2")], "feature string, level string")
    return A.semantic_missingness(coded_lines(spark, sf).select(state.alias("state")), ["state"], vocab)


@query(
    f"""WITH {COHORT} SELECT survey_year, seg, count(*) AS n, sum(y) AS events, round(sum(w * y) / sum(w), 6) AS event_rate, round(pow(sum(w), 2) / sum(w * w), 6) AS ess,
 count(DISTINCT stratum) AS strata, count(DISTINCT psu) AS psus, round(quantile_cont(w, 0.25), 6) AS w_p25, round(quantile_cont(w, 0.5), 6) AS w_p50, round(quantile_cont(w, 0.75), 6) AS w_p75 FROM cohort GROUP BY 1, 2"""
)
def cohort_table(spark, sf):
    return rounded(A.cohort_table(order_cohort(spark, sf), ["survey_year", "seg"], "y", "w", "stratum", "psu"))


_DS = ", ".join(f"round(quantile_cont(p1, {p / 100}), 6) AS p{p}" for p in (10, 25, 50, 75, 90))


@query(
    f"""WITH {COHORT} SELECT seg, count(p1) AS n, round(avg(p1), 6) AS mean, round(stddev_samp(p1), 6) AS std, {_DS}, round(quantile_cont(p1, 0.75) - quantile_cont(p1, 0.25), 6) AS iqr,
 round(count(*) FILTER (p1 >= 0.5) / count(p1), 6) AS share_half FROM cohort GROUP BY seg"""
)
def distribution_summary(spark, sf):
    return rounded(A.distribution_summary(order_cohort(spark, sf), ["seg"], "p1"))


@query(f"WITH {LONG} SELECT attr, grp, y, yhat, count(*) AS n, round(sum(w), 6) AS sw, round(sum(w * p1), 6) AS swq, round(sum(p1), 6) AS sq FROM long GROUP BY 1, 2, 3, 4")
def rate_table(spark, sf):
    from ..functions.columns import by_attr

    long = by_attr(order_cohort(spark, sf), ["seg", "bal_hi"], ["y", "yhat", "w", "p1"])
    return rounded(long.groupBy("attr", "grp", "y", "yhat").agg(F.count("*").alias("n"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("p1")).alias("swq"), F.sum("p1").alias("sq")))


