"""Evaluation metrics (per group, pair and attribute) on the derived cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cohort import order_cohort
from ..functions.columns import dim, rounded
from ..operators import metrics as M
from ..operators import ranking as R
from .registry import COHORT, EXPECTED, EXPECTED_SQL, LONG, query

ATTRS = ["seg", "bal_hi"]

_RATES = LONG + """, k AS (SELECT attr, grp, cls, sum(CASE WHEN y = cls AND yhat = cls THEN 1 ELSE 0 END) AS tp,
 sum(CASE WHEN y <> cls AND yhat <> cls THEN 1 ELSE 0 END) AS tn, sum(CASE WHEN y <> cls AND yhat = cls THEN 1 ELSE 0 END) AS fp,
 sum(CASE WHEN y = cls AND yhat <> cls THEN 1 ELSE 0 END) AS fn FROM long, (VALUES (0), (1)) c(cls) GROUP BY attr, grp, cls),
rates AS (SELECT *, coalesce(tp / nullif(tp + fn, 0), 0) AS "TPR", coalesce(fp / nullif(fp + tn, 0), 0) AS "FPR", coalesce(tp / nullif(tp + fp, 0), 0) AS "PPV",
 coalesce(tn / nullif(tn + fn, 0), 0) AS "NPV", (tp + tn) / (tp + tn + fp + fn) AS "ACC", (tp + fp) / (tp + tn + fp + fn) AS "PPOS",
 coalesce(fp / nullif(tp + fp, 0), 0) AS "FDR", coalesce(fn / nullif(tn + fn, 0), 0) AS "FOR", coalesce(fn / nullif(tp + fn, 0), 0) AS "FNR",
 coalesce(tn / nullif(fp + tn, 0), 0) AS "TNR" FROM k)"""


def _gap_sql(value: str) -> str:
    return f"""{_RATES}, pairs AS (SELECT a.attr, a.grp AS ga, b.grp AS gb, max({value}) AS v FROM rates a JOIN rates b
 ON a.attr = b.attr AND a.cls = b.cls AND a.grp < b.grp GROUP BY a.attr, a.grp, b.grp)"""


def _value(name: str) -> str:
    d = [f'abs(a."{r}" - b."{r}")' for r in M.GAPS[name]]
    return d[0] if len(d) == 1 else f"greatest({', '.join(d)})"


def expected(spark: SparkSession) -> DataFrame:
    return dim(spark, EXPECTED, "attr string, grp string")


_R = ", ".join(f'round("{r}", 6) AS "{r}"' for r in M.RATES)


@query(f"WITH {_RATES} SELECT attr, grp, cls, tp, tn, fp, fn, {_R} FROM rates")
def confusion_rates(spark, sf):
    return rounded(M.confusion_rates(order_cohort(spark, sf), ATTRS))


def _register_gap(name: str) -> None:
    @query(f"WITH {_gap_sql(_value(name))} SELECT attr, round(avg(v), 6) AS value FROM pairs GROUP BY attr", f"gap_{name}")
    def run(spark, sf):
        return rounded(M.gap(M.confusion_rates(order_cohort(spark, sf), ATTRS), name))


for _name in M.GAPS:
    _register_gap(_name)

_SUM = 'abs(a."TPR" - b."TPR") + abs(a."FPR" - b."FPR")'


@query(f"WITH {_gap_sql(_SUM)} SELECT attr, round(avg(v), 6) AS value FROM pairs GROUP BY attr")
def gap_EO_sum(spark, sf):
    return rounded(M.gap(M.confusion_rates(order_cohort(spark, sf), ATTRS), "EO", "sum"))


_BALANCE = """m AS (SELECT attr, grp, y, avg(p1) AS m FROM long GROUP BY attr, grp, y),
bp AS (SELECT a.attr, a.grp AS ga, b.grp AS gb, max(abs(a.m - b.m)) AS v FROM m a JOIN m b ON a.attr = b.attr AND a.y = b.y AND a.grp < b.grp GROUP BY a.attr, a.grp, b.grp),
balance AS (SELECT attr, round(avg(v), 6) AS value FROM bp GROUP BY attr)"""


@query(f"WITH {LONG}, {_BALANCE} SELECT * FROM balance")
def gap_BNC(spark, sf):
    return rounded(M.score_balance(order_cohort(spark, sf), ATTRS))


@query(f"WITH {LONG}, {_BALANCE} SELECT * FROM balance")
def gap_BPC(spark, sf):
    return rounded(M.score_balance(order_cohort(spark, sf), ATTRS))


_ALL = ", ".join(f"max({_value(n)}) AS \"{n}\"" for n in M.GAPS)


@query(
    f"WITH {_RATES}, {_BALANCE}, ap AS (SELECT a.attr, a.grp AS ga, b.grp AS gb, {_ALL} FROM rates a JOIN rates b ON a.attr = b.attr AND a.cls = b.cls AND a.grp < b.grp GROUP BY a.attr, a.grp, b.grp) "
    + " UNION ALL ".join(f"SELECT attr, '{n}' AS metric, round(avg(\"{n}\"), 6) AS value FROM ap GROUP BY attr" for n in M.GAPS)
    + "".join(f" UNION ALL SELECT attr, '{n}', value FROM balance" for n in ("BNC", "BPC"))
)
def all_gaps(spark, sf):
    return rounded(M.all_gaps(order_cohort(spark, sf), ATTRS))


_CLS = f"""{COHORT}, k AS (SELECT seg, cls, sum(CASE WHEN y = cls AND yhat = cls THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y <> cls AND yhat <> cls THEN 1 ELSE 0 END) AS tn,
 sum(CASE WHEN y <> cls AND yhat = cls THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN y = cls AND yhat <> cls THEN 1 ELSE 0 END) AS fn
 FROM cohort, (VALUES (0), (1)) c(cls) GROUP BY seg, cls),
v AS (SELECT *, tp + fn AS s, (tp + tn) / (tp + tn + fp + fn) AS accuracy, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
 coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM k)"""
_ACC = ("accuracy", "f1", "recall", "precision")


@query(f"WITH {_CLS} SELECT seg, {', '.join(f'round({m}, 6) AS {m}' for m in _ACC)} FROM v WHERE cls = 1")
def acc_metrics(spark, sf):
    return rounded(M.acc_metrics(order_cohort(spark, sf), ["seg"]))


@query(f"WITH {_CLS} SELECT seg, {', '.join(f'round(sum({m} * s) / sum(s), 6) AS {m}' for m in _ACC)} FROM v GROUP BY seg")
def acc_metrics_weighted(spark, sf):
    return rounded(M.acc_metrics(order_cohort(spark, sf), ["seg"], weighted=True))


_GROUPS = LONG + """, g AS (SELECT attr, grp, count(*) AS n, sum(y) AS positives, count(*) - sum(y) AS negatives, sum(yhat) AS selected,
 sum(y) / count(*) AS prevalence, sum(yhat) / count(*) AS selection_rate, sum(y * yhat) / nullif(sum(y), 0) AS tpr,
 sum((1 - y) * yhat) / nullif(count(*) - sum(y), 0) AS fpr, sum(y * yhat) / nullif(sum(yhat), 0) AS ppv FROM long GROUP BY attr, grp)"""
_G = ", ".join(f"round({c}, 6) AS {c}" for c in ("prevalence", "selection_rate", "tpr", "fpr", "ppv"))


def groups(spark, sf):
    return M.group_metrics(order_cohort(spark, sf), ATTRS)


@query(f"WITH {_GROUPS} SELECT attr, grp, n, positives, negatives, selected, {_G} FROM g")
def group_metrics(spark, sf):
    return rounded(groups(spark, sf))


_FG = """fg AS (SELECT attr, CASE WHEN count(selection_rate) >= 2 THEN max(selection_rate) - min(selection_rate) END AS dp,
 CASE WHEN count(tpr) >= 2 THEN max(tpr) - min(tpr) END AS eopp, CASE WHEN count(fpr) >= 2 THEN max(fpr) - min(fpr) END AS fpr_gap FROM g GROUP BY attr)"""


@query(f"WITH {_GROUPS}, {_FG} SELECT attr, round(dp, 6) AS dp, round(eopp, 6) AS eopp, round(fpr_gap, 6) AS fpr_gap, round(greatest(eopp, fpr_gap), 6) AS eo FROM fg")
def fairness_gaps(spark, sf):
    return rounded(M.fairness_gaps(groups(spark, sf)))


@query(
    f"WITH {_GROUPS} SELECT a.attr, a.grp AS grp_a, b.grp AS grp_b, "
    + ", ".join(f"round(abs(a.{c} - b.{c}), 6) AS d_{c}" for c in ("selection_rate", "tpr", "fpr", "ppv"))
    + " FROM g a JOIN g b ON a.attr = b.attr AND a.grp < b.grp"
)
def pairwise_differences(spark, sf):
    return rounded(M.pairwise_differences(groups(spark, sf)))


@query(
    f"""WITH {_GROUPS}, {EXPECTED_SQL}, f AS (SELECT coalesce(e.attr, g.attr) AS attr, e.grp AS wanted, g.grp AS seen FROM expected e FULL JOIN g ON e.attr = g.attr AND e.grp = g.grp)
SELECT attr, count(wanted) AS expected, count(CASE WHEN wanted IS NOT NULL THEN seen END) AS observed,
 CAST(count(wanted) * (count(wanted) - 1) // 2 AS BIGINT) AS expected_pairs,
 coalesce(string_agg(CASE WHEN seen IS NULL THEN wanted END, ',' ORDER BY wanted), '') AS missing,
 coalesce(string_agg(CASE WHEN wanted IS NULL THEN seen END, ',' ORDER BY seen), '') AS unexpected FROM f GROUP BY attr"""
)
def group_coverage(spark, sf):
    return M.group_coverage(groups(spark, sf), expected(spark))


@query(
    f"""WITH {_GROUPS}, {EXPECTED_SQL}, a AS (SELECT e.attr, count(*) AS wanted, count(n) AS observed, min(positives) AS lp, min(negatives) AS ln,
 max(selection_rate) - min(selection_rate) AS gs, max(tpr) - min(tpr) AS gt, max(fpr) - min(fpr) AS gf FROM expected e LEFT JOIN g ON e.attr = g.attr AND e.grp = g.grp GROUP BY e.attr),
s AS (SELECT *, CASE WHEN wanted < 2 THEN 'SINGLE_GROUP' WHEN observed < wanted THEN 'MISSING_EXPECTED_GROUPS' END AS c FROM a),
t AS (SELECT *, coalesce(c, 'VALID') AS dp_status, coalesce(c, CASE WHEN lp = 0 THEN 'MISSING_POSITIVE' END, 'VALID') AS eopp_status,
 coalesce(c, CASE WHEN lp = 0 THEN 'MISSING_POSITIVE' WHEN ln = 0 THEN 'MISSING_NEGATIVE' END, 'VALID') AS eo_status FROM s)
SELECT attr, round(CASE WHEN dp_status = 'VALID' THEN gs END, 6) AS dp, dp_status, round(CASE WHEN eopp_status = 'VALID' THEN gt END, 6) AS eopp, eopp_status,
 round(CASE WHEN eo_status = 'VALID' THEN greatest(gt, gf) END, 6) AS eo, eo_status FROM t"""
)
def app_fairness(spark, sf):
    return rounded(M.app_fairness(order_cohort(spark, sf), expected(spark), ATTRS))


def _weighted(q: str) -> str:
    return f"""sum(w * {q}) / sum(w) AS sr, sum(w * {q} * y) / nullif(sum(w * y), 0) AS tpr, sum(w * (1 - {q}) * (1 - y)) / nullif(sum(w * (1 - y)), 0) AS tnr,
 sum(w * {q} * (1 - y)) / nullif(sum(w * (1 - y)), 0) AS fpr, sum(w * {q} * y) / nullif(sum(w * {q}), 0) AS ppv,
 sum(w * (1 - {q}) * (1 - y)) / nullif(sum(w * (1 - {q})), 0) AS npv, sum(w * ({q} * y + (1 - {q}) * (1 - y))) / sum(w) AS accuracy"""


@query(
    f"WITH {COHORT}, k AS (SELECT seg, {_weighted('p1')} FROM cohort GROUP BY seg) SELECT seg, round((tpr + tnr) / 2, 6) AS ba, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in ("sr", "tpr", "tnr", "fpr", "ppv", "npv", "accuracy"))
    + " FROM k"
)
def weighted_confusion(spark, sf):
    return rounded(M.weighted_confusion(order_cohort(spark, sf), ["seg"]))


@query(
    f"""WITH {LONG}, {EXPECTED_SQL}, k AS (SELECT attr, grp, count(*) AS n, pow(sum(w), 2) / sum(w * w) AS ess, {_weighted('p1')} FROM long GROUP BY attr, grp),
j AS (SELECT e.attr, count(*) AS groups, min(n) AS least_n, min(ess) AS least_ess, CASE WHEN count(sr) = count(*) THEN max(sr) - min(sr) END AS dp,
 CASE WHEN count(tpr) = count(*) THEN max(tpr) - min(tpr) END AS eopp, CASE WHEN count(fpr) = count(*) THEN max(fpr) - min(fpr) END AS fpr_gap
 FROM expected e LEFT JOIN k ON e.attr = k.attr AND e.grp = k.grp GROUP BY e.attr)
SELECT attr, round(dp, 6) AS dp, round(eopp, 6) AS eopp, round(fpr_gap, 6) AS fpr_gap, least_n, round(least_ess, 6) AS least_ess, groups,
 round(CASE WHEN eopp IS NOT NULL AND fpr_gap IS NOT NULL THEN greatest(eopp, fpr_gap) END, 6) AS eo,
 CASE WHEN eopp IS NOT NULL AND fpr_gap IS NOT NULL AND dp IS NOT NULL THEN 'ESTIMABLE' ELSE 'NOT_ESTIMABLE' END AS status FROM j"""
)
def survey_fairness(spark, sf):
    return rounded(M.survey_fairness(order_cohort(spark, sf), expected(spark), ATTRS))


_CMP = ("selection_rate", "tpr", "fpr")


def _cmp_side(pred: str) -> str:
    return f"""SELECT attr, grp, sum({pred}) / count(*) AS selection_rate, sum(y * {pred}) / nullif(sum(y), 0) AS tpr,
 sum((1 - y) * {pred}) / nullif(count(*) - sum(y), 0) AS fpr FROM long2 GROUP BY attr, grp"""


_COMPARE = f"""WITH {LONG}, long2 AS (SELECT *, CASE WHEN p2 >= 0.5 THEN 1 ELSE 0 END AS yhat2 FROM long), a AS ({_cmp_side('yhat')}), b AS ({_cmp_side('yhat2')}) """ + " UNION ALL ".join(
    f"SELECT a.attr, a.grp, '{m}' AS metric, round(a.{m}, 6) AS before, round(b.{m}, 6) AS after, round(b.{m} - a.{m}, 6) AS delta FROM a JOIN b ON a.attr = b.attr AND a.grp = b.grp"
    for m in _CMP
)


@query(_COMPARE)
def evaluation_comparison(spark, sf):
    df = order_cohort(spark, sf).withColumn("yhat2", (F.col("p2") >= 0.5).cast("int"))
    a, b = M.group_metrics(df, ATTRS), M.group_metrics(df, ATTRS, pred="yhat2")
    return rounded(M.evaluation_comparison(a, b, ["attr", "grp"], list(_CMP)))


@query(
    f"""WITH {COHORT}, a AS (SELECT record_key, y, seg, yhat FROM cohort), b AS (SELECT record_key, CASE WHEN p2 >= 0.5 THEN 1 ELSE 0 END AS yhat FROM cohort WHERE survey_year > 1995)
SELECT seg, y, a.yhat AS before, b.yhat AS after, count(*) AS n FROM a LEFT JOIN b ON a.record_key = b.record_key GROUP BY 1, 2, 3, 4"""
)
def join_before_after(spark, sf):
    """How decisions moved, by segment and outcome; rows without a decision after have null there."""
    df = order_cohort(spark, sf)
    after = df.filter("survey_year > 1995").select("record_key", (F.col("p2") >= 0.5).cast("int").alias("after"))
    both = df.select("record_key", "y", "seg", F.col("yhat").alias("before")).join(after, "record_key", "left")
    return both.groupBy("seg", "y", "before", "after").agg(F.count("*").alias("n"))


_AUC = """sum(CAST(pos AS DOUBLE) * (below + neg / 2)) / (sum(pos) * sum(neg))"""
_PTS = """p AS (SELECT seg, p1, sum(y) AS pos, sum(1 - y) AS neg FROM cohort GROUP BY seg, p1),
c AS (SELECT *, sum(neg) OVER (PARTITION BY seg ORDER BY p1) - neg AS below, sum(pos) OVER (PARTITION BY seg ORDER BY p1 DESC) AS tp,
 sum(neg) OVER (PARTITION BY seg ORDER BY p1 DESC) AS fp, sum(pos) OVER (PARTITION BY seg) AS ap, sum(neg) OVER (PARTITION BY seg) AS an FROM p)"""


@query(f"WITH {COHORT}, {_PTS} SELECT seg, round({_AUC}, 6) AS auroc FROM c GROUP BY seg")
def auroc(spark, sf):
    return rounded(R.auroc(order_cohort(spark, sf), ["seg"]))


@query(f"WITH {COHORT}, {_PTS} SELECT seg, round(sum((tp / (tp + fp)) * (pos / ap)), 6) AS ap FROM c GROUP BY seg")
def average_precision(spark, sf):
    return rounded(R.average_precision(order_cohort(spark, sf), ["seg"]))


@query(
    f"""WITH {COHORT}, {_PTS}, t AS (SELECT *, tp / ap AS r, tp / (tp + fp) AS pr, coalesce(lag(tp / ap) OVER (PARTITION BY seg ORDER BY p1 DESC), 0) AS r0,
 coalesce(lag(tp / (tp + fp)) OVER (PARTITION BY seg ORDER BY p1 DESC), 1) AS pr0 FROM c)
SELECT seg, round(sum((r - r0) * (pr + pr0) / 2), 6) AS auprc FROM t GROUP BY seg"""
)
def auprc_trapezoid(spark, sf):
    return rounded(R.auprc_trapezoid(order_cohort(spark, sf), ["seg"]))


@query(f"WITH {COHORT}, {_PTS} SELECT seg, round(max(abs((ap - tp + pos) / ap - (an - fp + neg) / an)), 6) AS ks FROM c GROUP BY seg")
def ks_two_sample(spark, sf):
    return rounded(R.ks_two_sample(order_cohort(spark, sf), ["seg"]))


@query(f"WITH {COHORT} SELECT seg, round(sum(w * pow(y - p1, 2)) / sum(w), 6) AS brier FROM cohort GROUP BY seg")
def brier(spark, sf):
    return rounded(R.brier(order_cohort(spark, sf), ["seg"]))


@query(
    f"""WITH {COHORT}, b AS (SELECT CAST(least(floor(p1 * 10), 9) AS INT) AS bin, count(*) AS n, sum(w) AS sw, sum(w * p1) AS sp, sum(w * y) AS sy FROM cohort GROUP BY 1)
SELECT CAST(i AS INT) AS bin, coalesce(n, 0) AS n, round(coalesce(sw, 0) / (SELECT sum(sw) FROM b), 6) AS weight_share, round(sp / sw, 6) AS mean_score,
 round(sy / sw, 6) AS observed_rate FROM range(10) r(i) LEFT JOIN b ON b.bin = i"""
)
def calibration_curve(spark, sf):
    return rounded(R.calibration_curve(order_cohort(spark, sf), []))


@query(
    f"""WITH {COHORT}, {_PTS}, u AS (SELECT seg, {_AUC} AS auroc, sum((tp / (tp + fp)) * (pos / ap)) AS ap FROM c GROUP BY seg),
b AS (SELECT seg, sum(w * pow(y - p1, 2)) / sum(w) AS brier FROM cohort GROUP BY seg)
SELECT seg, round(auroc, 6) AS auroc, round(ap, 6) AS ap, round(brier, 6) AS brier, 'AVAILABLE' AS status FROM u JOIN b USING (seg)"""
)
def risk_metrics(spark, sf):
    df = order_cohort(spark, sf)
    out = R.auroc(df, ["seg"]).join(R.average_precision(df, ["seg"]), "seg").join(R.brier(df, ["seg"]), "seg")
    return rounded(out.withColumn("status", F.when(F.col("auroc").isNull(), "NOT_AVAILABLE").otherwise("AVAILABLE")))


@query(
    f"""WITH {COHORT}, {_PTS}, u AS (SELECT seg, {_AUC} AS auroc, sum((tp / (tp + fp)) * (pos / ap)) AS ap FROM c GROUP BY seg),
k AS (SELECT seg, sum(y * yhat) AS tp, sum((1 - y) * yhat) AS fp, sum(y * (1 - yhat)) AS fn, sum((1 - y) * (1 - yhat)) AS tn FROM cohort GROUP BY seg)
SELECT seg, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS ba, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy,
 'VALID' AS status, round(auroc, 6) AS auroc, round(ap, 6) AS ap FROM k JOIN u USING (seg)"""
)
def utility_metrics(spark, sf):
    return rounded(R.utility_metrics(order_cohort(spark, sf), ["seg"]))


@query(
    f"""WITH {COHORT}, {_PTS}, m AS (SELECT seg, (p1 + lead(p1) OVER (PARTITION BY seg ORDER BY p1)) / 2 AS threshold, tp - pos AS tp, an - fp + neg AS tn, ap, an FROM c),
z AS (SELECT seg, threshold, tp, tn, ap, an FROM m WHERE threshold IS NOT NULL UNION ALL SELECT DISTINCT seg, 0, ap, 0, ap, an FROM c
 UNION ALL SELECT seg, 1, sum(CASE WHEN p1 >= 1 THEN pos ELSE 0 END), sum(CASE WHEN p1 < 1 THEN neg ELSE 0 END), ap, an FROM c GROUP BY seg, ap, an),
s AS (SELECT seg, threshold, round((tp / ap + tn / an) / 2, 12) AS ba FROM z)
SELECT seg, round(threshold, 6) AS threshold, round(ba, 6) AS ba FROM s
QUALIFY row_number() OVER (PARTITION BY seg ORDER BY ba DESC, round(abs(threshold - 0.5), 9), threshold DESC) = 1"""
)
def threshold_search_ba(spark, sf):
    return rounded(R.threshold_search_ba(order_cohort(spark, sf), ["seg"]))


@query(f"WITH {COHORT} SELECT record_key, p1, CASE WHEN p1 >= 0.5 THEN 1 ELSE 0 END AS yhat FROM cohort")
def threshold_decision(spark, sf):
    return order_cohort(spark, sf).select("record_key", "p1", (F.col("p1") >= 0.5).cast("int").alias("yhat"))
