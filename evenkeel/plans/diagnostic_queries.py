"""Stepwise replay, reporting and comparison queries; states mix two scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cohort import order_cohort
from ..functions.columns import rounded
from ..operators import diagnostics as D
from ..operators import ranking as R
from ..operators import transforms as X
from .registry import COHORT, query

_STATES = COHORT + """, st AS (SELECT survey_year, seg, y, w, k, (p1 * (4 - k) + p2 * k) / 4 AS s FROM cohort, (VALUES (0), (1), (2), (3)) v(k)),
ms AS (SELECT survey_year, k AS state, round(avg(CAST(CASE WHEN s >= 0.5 THEN 1 ELSE 0 END AS DOUBLE)), 9) AS sr, round(sum(w * pow(y - s, 2)) / sum(w), 9) AS brier FROM st GROUP BY 1, 2)"""


def states(spark, sf):
    df = order_cohort(spark, sf).withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(4)])))
    return df.withColumn("s", (F.col("p1") * (4 - F.col("k")) + F.col("p2") * F.col("k")) / 4)


def state_metrics(spark, sf):
    hit = (F.col("s") >= 0.5).cast("double")
    out = states(spark, sf).groupBy("survey_year", F.col("k").alias("state"))
    return out.agg(F.round(F.avg(hit), 9).alias("sr"), F.round(F.sum(F.col("w") * F.pow(F.col("y") - F.col("s"), 2)) / F.sum("w"), 9).alias("brier"))


@query(f"WITH {_STATES} SELECT survey_year, state, round(sr, 6) AS sr, round(brier, 6) AS brier FROM ms")
def stepwise_metrics(spark, sf):
    return rounded(state_metrics(spark, sf))


_DELTA = "dl AS (SELECT survey_year, state, sr, sr - lag(sr) OVER (PARTITION BY survey_year ORDER BY state) AS d_previous, sr - first(sr) OVER (PARTITION BY survey_year ORDER BY state) AS d_first FROM ms)"


def _deltas(spark, sf):
    return D.stepwise_deltas(state_metrics(spark, sf), ["survey_year"], "state", "sr")


@query(f"WITH {_STATES}, {_DELTA} SELECT survey_year, state, round(d_previous, 6) AS d_previous, round(d_first, 6) AS d_first FROM dl")
def stepwise_deltas(spark, sf):
    return rounded(_deltas(spark, sf).select("survey_year", "state", "d_previous", "d_first"))


@query(
    f"""WITH {_STATES}, {_DELTA}, t AS (SELECT *, row_number() OVER (ORDER BY abs(d_previous) DESC, state) AS rank FROM dl WHERE survey_year = 1999 AND d_previous IS NOT NULL)
SELECT 'sr' AS metric, t.state, t.rank, round(t.d_previous, 6) AS delta, round(o.d_previous, 6) AS other,
 CASE WHEN t.d_previous <> 0 AND o.d_previous <> 0 THEN sign(t.d_previous) = sign(o.d_previous) END AS same_direction FROM t LEFT JOIN dl o ON o.survey_year = 2000 AND o.state = t.state WHERE t.rank <= 3"""
)
def key_path_top3(spark, sf):
    d = _deltas(spark, sf).withColumn("metric", F.lit("sr"))
    return rounded(D.key_path_top(d, ["metric"], "survey_year", "state", 1999, 2000))


_MERGED = "CASE WHEN prio IN ('1-URGENT', '2-HIGH') THEN '3-MEDIUM' ELSE prio END"
_CS = f"cs AS (SELECT 'before' AS side, prio AS category, y FROM cohort UNION ALL SELECT 'after', {_MERGED}, y FROM cohort)"


def _prio():
    m = F.create_map(F.lit("1-URGENT"), F.lit("3-MEDIUM"), F.lit("2-HIGH"), F.lit("3-MEDIUM"))
    return {"prio": F.col("prio")}, {"prio": X.merge_categories(F.col("prio"), m)}


@query(f"WITH {COHORT}, {_CS} SELECT 'prio' AS feature, side, category, count(*) AS n, sum(y) AS positives, round(sum(y) / count(*), 6) AS prevalence FROM cs GROUP BY 2, 3")
def category_states(spark, sf):
    return rounded(D.category_states(order_cohort(spark, sf), *_prio(), "y"))


@query(f"WITH {COHORT}, {_CS} SELECT 'prio' AS feature, count(DISTINCT category) FILTER (side = 'before') AS levels_before, count(DISTINCT category) FILTER (side = 'after') AS levels_after FROM cs")
def compression_summary(spark, sf):
    cells = D.category_states(order_cohort(spark, sf), *_prio(), "y")
    return cells.groupBy("feature").agg(*[F.count_if(F.col("side") == s).alias(f"levels_{s}") for s in ("before", "after")])


_PG = "pg AS (SELECT 'raw' AS name, acctbal AS x FROM cohort UNION ALL SELECT 'powered', sign(acctbal) * pow(abs(acctbal) / 1000, 3) FROM cohort UNION ALL SELECT 'scaled', acctbal / 10000 FROM cohort)"


@query(f"WITH {COHORT}, {_PG} SELECT name, {', '.join(f'round(quantile_cont(x, {q}), 6) AS q{i}' for i, q in enumerate((0, 0.25, 0.5, 0.75, 1)))} FROM pg GROUP BY name")
def power_geometry(spark, sf):
    a = F.col("acctbal")
    return rounded(D.power_geometry(order_cohort(spark, sf), {"raw": a, "powered": X.power(a / 1000, 3), "scaled": a / 10000}))


_SD = "count(p1) AS n, round(avg(p1), 6) AS mean, round(stddev_samp(p1), 6) AS std, round(quantile_cont(p1, 0.5), 6) AS median"


@query(f"WITH {COHORT} SELECT survey_year, y, {_SD} FROM cohort GROUP BY GROUPING SETS ((survey_year), (survey_year, y))")
def score_distribution(spark, sf):
    return rounded(D.score_distribution(order_cohort(spark, sf), ["survey_year"], "y", "p1"))


@query(f"WITH {COHORT} SELECT seg, stratum, y, {_SD} FROM cohort GROUP BY GROUPING SETS ((seg, stratum), (seg, stratum, y))")
def group_score_distribution(spark, sf):
    return rounded(D.score_distribution(order_cohort(spark, sf), ["seg", "stratum"], "y", "p1"))


_BETA = {"price": 0.00001, "p1": 1.5, "p2": -0.75}
_LC = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, CAST({b} AS DOUBLE) AS beta, round(CAST({b} AS DOUBLE) * avg(CASE WHEN y = 1 THEN {f} END), 6) AS class1, round(CAST({b} AS DOUBLE) * avg(CASE WHEN y = 0 THEN {f} END), 6) AS class0, "
    f"round(CAST({b} AS DOUBLE) * (avg(CASE WHEN y = 1 THEN {f} END) - avg(CASE WHEN y = 0 THEN {f} END)), 6) AS separation FROM cohort"
    for f, b in _BETA.items()
)


@query(f"WITH {COHORT} {_LC}")
def logit_contributions(spark, sf):
    return rounded(D.logit_contributions(order_cohort(spark, sf), "y", _BETA))


@query(f"WITH {COHORT}, lc AS ({_LC}) SELECT feature, separation, row_number() OVER (ORDER BY abs(separation) DESC, feature) AS rank FROM lc")
def mechanism_summary(spark, sf):
    from pyspark.sql import Window

    c = rounded(D.logit_contributions(order_cohort(spark, sf), "y", _BETA))
    w = Window.orderBy(F.desc(F.abs("separation")), "feature")  # a row per feature
    return c.select("feature", "separation", F.row_number().over(w).alias("rank")).filter("rank <= 5")


#: A run log from the data: an order is a step, its priority the operation, its price the time it took.
_LOG = "SELECT prio AS operation, seg AS decision, count(*) AS n, round(avg(price), 6) AS mean, round(quantile_cont(price, 0.5), 6) AS median, min(price) AS min, max(price) AS max FROM cohort GROUP BY 1, 2"


@query(f"WITH {COHORT} {_LOG}")
def trace_aggregate(spark, sf):
    df = order_cohort(spark, sf).select(F.col("prio").alias("operation"), F.col("seg").alias("decision"), "price")
    return rounded(D.trace_aggregate(df, ["operation", "decision"], "price"))


_KINDS = ["1-URGENT", "2-HIGH", "5-LOW"]


@query(
    f"WITH {COHORT} SELECT psu AS feature, "
    + ", ".join(f"count(DISTINCT CASE WHEN prio = '{k}' THEN record_key % 5 END) AS \"{k}\"" for k in _KINDS)
    + ', count(DISTINCT record_key % 5) AS "any" FROM cohort GROUP BY psu'
)
def feature_frequency(spark, sf):
    df = order_cohort(spark, sf).select(F.col("psu").alias("feature"), (F.col("record_key") % 5).alias("seed"), "prio")
    return D.feature_frequency(df, "feature", "seed", "prio", _KINDS)


@query(f"WITH {COHORT} SELECT seg, prio, count(*) AS n FROM cohort GROUP BY ROLLUP (seg, prio)")
def failure_counts(spark, sf):
    return order_cohort(spark, sf).rollup("seg", "prio").agg(F.count("*").alias("n"))


_RC = """ra1 AS (SELECT seg, survey_year, round(avg(p1), 9) AS v FROM cohort WHERE survey_year < 2001 GROUP BY 1, 2), rb1 AS (SELECT seg, survey_year, round(avg(p2), 9) AS v FROM cohort WHERE survey_year > 1995 GROUP BY 1, 2),
rj AS (SELECT coalesce(a.seg, b.seg) AS seg, coalesce(a.survey_year, b.survey_year) AS survey_year, a.v AS reference, b.v AS observed FROM ra1 a FULL JOIN rb1 b ON a.seg = b.seg AND a.survey_year = b.survey_year)"""
_STATUS = "CASE WHEN reference IS NULL THEN 'NO_REFERENCE' WHEN observed IS NULL THEN 'NOT_OBSERVED' WHEN abs(reference - observed) <= {t} THEN 'MATCH' ELSE 'DIFFERS' END AS status"


def _sides(spark, sf):
    df = order_cohort(spark, sf)
    a = df.filter("survey_year < 2001").groupBy("seg", "survey_year").agg(F.round(F.avg("p1"), 9).alias("v"))
    return a, df.filter("survey_year > 1995").groupBy("seg", "survey_year").agg(F.round(F.avg("p2"), 9).alias("v"))


@query(f"WITH {COHORT}, {_RC} SELECT seg, survey_year, round(reference, 6) AS reference, round(observed, 6) AS observed, {_STATUS.format(t=0.01)} FROM rj")
def reproduction_check(spark, sf):
    return rounded(D.compare_within(*_sides(spark, sf), ["seg", "survey_year"], "v", 0.01))


@query(f"WITH {COHORT}, {_RC} SELECT survey_year, count(*) AS compared, count(*) FILTER (abs(reference - observed) <= 0.005) AS matched FROM rj GROUP BY 1")
def metric_compare(spark, sf):
    out = D.compare_within(*_sides(spark, sf), ["seg", "survey_year"], "v", 0.005)
    return out.groupBy("survey_year").agg(F.count("*").alias("compared"), F.count_if(F.col("status") == "MATCH").alias("matched"))


@query(
    f"""WITH {COHORT}, a AS (SELECT survey_year AS role, count(*) AS n FROM cohort WHERE y = 1 GROUP BY 1), b AS (SELECT survey_year AS role, count(*) AS n FROM cohort WHERE yhat = 1 AND survey_year <> 1997 GROUP BY 1)
SELECT coalesce(a.role, b.role) AS role, a.n AS reference, b.n AS observed, CASE WHEN a.n IS NULL THEN 'NO_REFERENCE' WHEN b.n IS NULL THEN 'NOT_OBSERVED' WHEN a.n = b.n THEN 'MATCH' ELSE 'DIFFERS' END AS status FROM a FULL JOIN b ON a.role = b.role"""
)
def cohort_compare(spark, sf):
    df = order_cohort(spark, sf).withColumn("role", F.col("survey_year"))
    a = df.filter("y = 1").groupBy("role").agg(F.count("*").alias("n"))
    return D.compare_within(a, df.filter("yhat = 1 and role <> 1997").groupBy("role").agg(F.count("*").alias("n")), ["role"], "n", 0)


@query(f"WITH {_STATES} SELECT survey_year, state, round(sr, 6) AS sr, round(brier, 6) AS brier FROM ms")
def result_flatten(spark, sf):
    nested = state_metrics(spark, sf).select("survey_year", "state", F.struct("sr", "brier").alias("result"))
    return rounded(D.result_flatten(nested, ["survey_year", "state"], "result"))


@query(
    f"""WITH {_STATES}, i AS (SELECT survey_year, sr AS sr0 FROM ms WHERE state = 0) SELECT survey_year, arg_min(state, brier * 1000 + state) AS state FROM ms JOIN i USING (survey_year) WHERE sr >= sr0 - 0.05 GROUP BY survey_year"""
)
def pareto_checkpoint(spark, sf):
    m = state_metrics(spark, sf)
    first = m.filter("state = 0").select("survey_year", F.col("sr").alias("sr0"))
    ok = m.join(first, "survey_year").filter(F.col("sr") >= F.col("sr0") - 0.05)
    return ok.groupBy("survey_year").agg(F.min_by("state", F.col("brier") * 1000 + F.col("state")).alias("state"))


_OVER = "OVER (PARTITION BY survey_year ORDER BY s{})"
_REPRESENTED = f"""e AS (SELECT survey_year, seg, y, w, s, CASE WHEN s >= 0.5 THEN 1 ELSE 0 END AS q FROM st WHERE k = 2), p AS (SELECT survey_year, s, sum(y) AS pos, sum(1 - y) AS neg FROM e GROUP BY 1, 2),
c AS (SELECT *, sum(neg) {_OVER.format('')} - neg AS below, sum(pos) {_OVER.format(' DESC')} AS tp, sum(neg) {_OVER.format(' DESC')} AS fp, sum(pos) OVER (PARTITION BY survey_year) AS ap FROM p),
u AS (SELECT survey_year, sum(CAST(pos AS DOUBLE) * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS auroc, sum((tp / (tp + fp)) * (pos / nullif(ap, 0))) AS ap FROM c GROUP BY 1),
k AS (SELECT survey_year, sum(y * q) AS tp, sum((1 - y) * q) AS fp, sum(y * (1 - q)) AS fn, sum((1 - y) * (1 - q)) AS tn, sum(w * pow(y - s, 2)) / sum(w) AS brier FROM e GROUP BY 1),
r AS (SELECT seg, sum(q) / count(*) AS sr, sum(y * q) / nullif(sum(y), 0) AS tpr, sum((1 - y) * q) / nullif(sum(1 - y), 0) AS fpr FROM e GROUP BY 1),
f AS (SELECT max(sr) - min(sr) AS dp, max(tpr) - min(tpr) AS eopp, max(fpr) - min(fpr) AS fpr_gap FROM r), v AS (SELECT *, tp + fn > 0 AND tn + fp > 0 AS valid FROM k JOIN u USING (survey_year), f)"""


@query(
    f"""WITH {_STATES}, {_REPRESENTED} SELECT survey_year, CASE WHEN valid THEN round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) END AS ba, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1,
 round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, CASE WHEN valid THEN 'VALID' ELSE 'SINGLE_CLASS' END AS status, CASE WHEN valid THEN round(auroc, 6) END AS auroc, CASE WHEN valid THEN round(ap, 6) END AS ap,
 round(brier, 6) AS brier, round(dp, 6) AS dp, round(eopp, 6) AS eopp, round(fpr_gap, 6) AS fpr_gap, round(greatest(eopp, fpr_gap), 6) AS eo FROM v"""
)
def evaluate_representation(spark, sf):
    from ..operators.metrics import fairness_gaps, group_metrics

    df = states(spark, sf).filter("k = 2").withColumn("yhat", (F.col("s") >= 0.5).cast("int"))
    out = R.utility_metrics(df, ["survey_year"], "y", "s", "yhat").join(R.brier(df, ["survey_year"], "y", "s"), "survey_year")
    return rounded(out.crossJoin(F.broadcast(fairness_gaps(group_metrics(df, ["seg"])).drop("attr"))))  # one row
