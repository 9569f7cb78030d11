"""Learners, weights and thresholds on the cohort: fitted on the years up to 1997, scored on all."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..cohort import order_cohort
from ..functions.columns import rounded
from ..operators import learners as L
from ..operators import metrics as M
from ..operators import ranking as R
from ..operators import reductions as D
from ..operators import thresholds as T
from ..sources.tabular import materialize
from .registry import COHORT, query

COLS = ["price", "acctbal", "p1", "p2", "n_lines"]


def _frames(spark, sf):
    # written once: fits and scores go over the rows many times, and would join and group the tables anew each time
    df = materialize(order_cohort(spark, sf), "cohort")
    return df, df.filter("survey_year <= 1997")


def _summary(scored):
    """(survey_year) n, mean score and AUROC."""
    base = scored.groupBy("survey_year").agg(F.count("*").alias("n"), F.round(F.avg("p_event"), 4).alias("mean"))
    return base.join(R.auroc(scored, ["survey_year"], "y", "p_event").withColumn("auroc", F.round("auroc", 4)), "survey_year")


#: The same from a table p (survey_year, y, p).
_SUMMARY = """r AS (SELECT survey_year, y, p, rank() OVER (PARTITION BY survey_year ORDER BY p) + (count(*) OVER (PARTITION BY survey_year, p) - 1) / 2 AS r FROM p)
SELECT survey_year, count(*) AS n, round(avg(p), 4) AS mean, round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * sum(1 - y), 0), 4) AS auroc FROM r GROUP BY survey_year"""


def _naive_bayes() -> str:
    """Posterior of class 1 under independent normal features, from the moments of the years up to 1997."""
    x = ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0) AS {c}" for c in COLS)
    m = ", ".join(f"avg({c}) AS m_{c}, var_pop({c}) AS v_{c}" for c in COLS)
    terms = " - ".join(f"(x.{c} - m_{c}) * (x.{c} - m_{c}) / (2 * v_{c}) - ln(v_{c}) / 2" for c in COLS)
    return f"""WITH {COHORT}, x AS (SELECT record_key, survey_year, y, {x} FROM cohort), m AS (SELECT y AS c, count(*) AS n, {m} FROM x WHERE survey_year <= 1997 GROUP BY y),
p AS (SELECT survey_year, y, 1 / (1 + exp(-sum((2 * c - 1) * (ln(n) - {terms})))) AS p FROM x, m GROUP BY record_key, survey_year, y), {_SUMMARY}"""


def _register(kind: str) -> None:
    @query(_naive_bayes() if kind == "nb" else None, name=f"clf_{kind}")
    def run(spark, sf):
        return _summary(L.fit_score(*_frames(spark, sf), COLS, "y", kind))


for _kind in ("lr", "tree", "rf", "gbt", "nb", "svm", "mlp"):
    _register(_kind)


@query()
def baseline_unmitigated(spark, sf):
    scored = L.fit_score(*_frames(spark, sf), COLS, "y", "lr")
    return rounded(M.fairness_gaps(M.group_metrics(scored.withColumn("yhat", (F.col("p_event") >= 0.33).cast("int")), ["seg", "bal_hi"])))


@query(
    f"""WITH {COHORT}, f AS (SELECT avg(CAST(price AS DOUBLE)) AS m1, stddev_samp(CAST(price AS DOUBLE)) AS s1, avg(CAST(acctbal AS DOUBLE)) AS m2, stddev_samp(CAST(acctbal AS DOUBLE)) AS s2 FROM cohort WHERE survey_year <= 1997),
x AS (SELECT record_key, survey_year, y, (price - m1) / s1 AS a, (acctbal - m2) / s2 AS b FROM cohort, f),
p AS (SELECT q.survey_year, q.y, list_avg(arg_min(t.y, (q.a - t.a) * (q.a - t.a) + (q.b - t.b) * (q.b - t.b), 5)) AS p
 FROM x q JOIN x t ON t.survey_year <= 1997 AND t.record_key <> q.record_key GROUP BY q.record_key, q.survey_year, q.y), {_SUMMARY}"""
)
def clf_knn(spark, sf):
    df, fit = _frames(spark, sf)
    return _summary(materialize(L.knn_score(df, fit, "record_key", ["price", "acctbal"], "y", keep=["survey_year", "y"]), "scored"))


@query()
def clf_adaboost(spark, sf):
    return _summary(L.adaboost_score(*_frames(spark, sf), "record_key", COLS, "y"))


def _discriminant(quadratic: bool) -> str:
    """Posterior of class 1 for two features, from the moments of the years up to 1997."""
    m = "m AS (SELECT y, count(*) AS n, avg(p1) AS m1, avg(p2) AS m2, covar_pop(p1, p1) AS s11, covar_pop(p1, p2) AS s12, covar_pop(p2, p2) AS s22 FROM cohort WHERE survey_year <= 1997 GROUP BY y)"
    if quadratic:
        v = ", ".join(f"CAST(0.99 AS DOUBLE) * s{x} * n / (n - 1)" + (" + CAST(0.01 AS DOUBLE)" if x != "12" else "") + f" AS v{x}" for x in ("11", "12", "22"))
    else:
        v = ", ".join(f"sum(n * s{x}) OVER () / sum(n) OVER () AS v{x}" for x in ("11", "12", "22"))
    q = "(v22 * (p1 - m1) * (p1 - m1) - 2 * v12 * (p1 - m1) * (p2 - m2) + v11 * (p2 - m2) * (p2 - m2)) / det"
    return f"""WITH {COHORT}, {m}, v AS (SELECT y, n, m1, m2, {v}, ln(n / sum(n) OVER ()) AS prior FROM m), w AS (SELECT *, v11 * v22 - v12 * v12 AS det FROM v),
s AS (SELECT record_key, w.y, -({q} + ln(det)) / 2 + prior AS s FROM cohort, w)
SELECT record_key, round(1 / (1 + exp(sum(CASE WHEN y = 0 THEN s ELSE -s END))), 6) AS p_event FROM s GROUP BY record_key"""


@query(_discriminant(False))
def clf_lda(spark, sf):
    return rounded(L.discriminant_score(*_frames(spark, sf), ["p1", "p2"], "y").select("record_key", "p_event"))


@query(_discriminant(True))
def clf_qda(spark, sf):
    return rounded(L.discriminant_score(*_frames(spark, sf), ["p1", "p2"], "y", quadratic=True, reg=0.01).select("record_key", "p_event"))


@query(f"WITH {COHORT} SELECT record_key, round(1 / (1 + exp(-(CAST(-0.2 AS DOUBLE) + CAST(1.5 AS DOUBLE) * (p1 - CAST(0.5 AS DOUBLE)) / CAST(0.3 AS DOUBLE) + CAST(-0.7 AS DOUBLE) * (p2 - CAST(0.5 AS DOUBLE)) / CAST(0.3 AS DOUBLE)))), 6) AS p_event FROM cohort")
def score_frozen_lr(spark, sf):
    model = {"p1": (1.5, 0.5, 0.3), "p2": (-0.7, 0.5, 0.3)}
    return rounded(order_cohort(spark, sf).select("record_key", L.score_linear(model, -0.2).alias("p_event")))


@query(f"WITH {COHORT} SELECT record_key, round(p1, 6) AS from_probability, round(1 / (1 + exp(-(4 * p2 - 2))), 6) AS from_margin FROM cohort")
def positive_probability(spark, sf):
    """The class-1 probability of each row, of a model that gives probabilities and of one that gives margins."""
    df = order_cohort(spark, sf).select("record_key", "p1", "p2")
    one = df.withColumn("probability", array_to_vector(F.array(1 - F.col("p1"), F.col("p1"))))
    margin = 4 * F.col("p2") - 2
    two = L.positive_probability(one, "from_probability").drop("probability").withColumn("rawPrediction", array_to_vector(F.array(-margin, margin)))
    return rounded(L.positive_probability(two, "from_margin").select("record_key", "from_probability", "from_margin"))


@query(
    f"""WITH {COHORT}, c AS (SELECT seg, y, sum(w) AS s FROM cohort GROUP BY 1, 2)
SELECT seg, y, round(sum(s) OVER (PARTITION BY seg) * sum(s) OVER (PARTITION BY y) / (sum(s) OVER () * s), 6) AS factor FROM c"""
)
def reweighing(spark, sf):
    return rounded(L.reweighing(order_cohort(spark, sf), "seg", "y", "w"))


_GRID = [i / 20 for i in range(1, 20)]
_TR = f"""gd AS (SELECT i / 20 AS t FROM range(1, 20) r(i)), tr AS (SELECT seg, t, count(*) AS n, sum(CASE WHEN y = 1 AND p1 >= t THEN 1 ELSE 0 END) / sum(y) AS tpr,
 sum(CASE WHEN y = 0 AND p1 >= t THEN 1 ELSE 0 END) / sum(1 - y) AS fpr, sum(CASE WHEN (p1 >= t) = (y = 1) THEN 1 ELSE 0 END) AS ok FROM cohort, gd GROUP BY 1, 2),
gi AS (SELECT *, dense_rank() OVER (ORDER BY seg) AS k FROM tr)"""


def _product(groups: int, bound: float) -> str:
    """All choices of a threshold for each group, brute force, those within the bound kept as groups are added."""
    steps = ["c1 AS (SELECT [t] AS ts, ok, n, tpr AS t0, tpr AS t1, fpr AS f0, fpr AS f1 FROM gi WHERE k = 1)"]
    for k in range(2, groups + 1):
        steps.append(
            f"c{k} AS (SELECT list_append(ts, t) AS ts, c.ok + g.ok AS ok, c.n + g.n AS n, least(t0, tpr) AS t0, greatest(t1, tpr) AS t1, least(f0, fpr) AS f0, greatest(f1, fpr) AS f1"
            f" FROM c{k - 1} c, gi g WHERE g.k = {k} AND greatest(t1, tpr) - least(t0, tpr) <= {bound} + 1e-12 AND greatest(f1, fpr) - least(f0, fpr) <= {bound} + 1e-12)"
        )
    return ", ".join(steps)


@query(
    f"""WITH {COHORT}, {_TR}, {_product(5, 0.05)}, best AS (SELECT ts, ok / n AS accuracy, greatest(t1 - t0, f1 - f0) AS eo FROM c5 ORDER BY round(ok / n, 12) DESC, ts LIMIT 1)
SELECT seg, round(ts[k], 6) AS t, round(accuracy, 6) AS accuracy, round(eo, 6) AS eo FROM best, (SELECT DISTINCT seg, k FROM gi)"""
)
def group_threshold_grid(spark, sf):
    rates = T.threshold_rates(order_cohort(spark, sf), "seg", "y", "p1", _GRID)
    return rounded(T.group_threshold_grid(rates, "seg", 0.05))


#: Hulls by the slopes to all points on either side; the common point among all corners and crossings of the hulls.
_MEET = """sc AS (SELECT seg, p1 AS t, sum(y) AS pos, count(*) - sum(y) AS neg FROM cohort GROUP BY 1, 2),
rc AS (SELECT seg, t, sum(neg) OVER d / sum(neg) OVER g AS fpr, sum(pos) OVER d / sum(pos) OVER g AS tpr FROM sc WINDOW d AS (PARTITION BY seg ORDER BY t DESC), g AS (PARTITION BY seg)
 UNION ALL SELECT DISTINCT seg, CAST('inf' AS DOUBLE), 0, 0 FROM sc),
tp AS (SELECT * FROM rc QUALIFY row_number() OVER (PARTITION BY seg, fpr ORDER BY tpr DESC) = 1),
sl AS (SELECT k.seg, k.t, k.fpr, k.tpr, min(CASE WHEN o.fpr < k.fpr THEN (k.tpr - o.tpr) / (k.fpr - o.fpr) END) AS before, max(CASE WHEN o.fpr > k.fpr THEN (o.tpr - k.tpr) / (o.fpr - k.fpr) END) AS after
 FROM tp k JOIN tp o ON o.seg = k.seg GROUP BY 1, 2, 3, 4),
hv AS (SELECT seg, t, fpr, tpr, lead(t, 1, t) OVER w AS t1, lead(fpr, 1, fpr) OVER w AS fpr1, lead(tpr, 1, tpr) OVER w AS tpr1 FROM sl
 WHERE before IS NULL OR after IS NULL OR before > after + 1e-12 WINDOW w AS (PARTITION BY seg ORDER BY fpr)),
xs AS (SELECT DISTINCT fpr AS x FROM hv), sg AS (SELECT DISTINCT seg FROM hv),
ht AS (SELECT seg, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM (SELECT q.seg, x, CASE WHEN fpr1 > fpr THEN tpr + (x - fpr) / (fpr1 - fpr) * (tpr1 - tpr) ELSE tpr END AS y
 FROM (SELECT seg, x FROM sg, xs) q ASOF JOIN hv ON q.seg = hv.seg AND q.x >= hv.fpr) WINDOW w AS (PARTITION BY seg ORDER BY x)),
cr AS (SELECT x FROM xs UNION SELECT a.x + (a.y - b.y) / (a.y - b.y - a.ny + b.ny) * (a.nx - a.x) FROM ht a JOIN ht b ON a.x = b.x AND a.seg < b.seg AND (a.y - b.y) * (a.ny - b.ny) < 0),
hc AS (SELECT q.seg, x, t, t1, CASE WHEN fpr1 > fpr THEN (x - fpr) / (fpr1 - fpr) ELSE 0 END AS mix, CASE WHEN fpr1 > fpr THEN tpr + (x - fpr) / (fpr1 - fpr) * (tpr1 - tpr) ELSE tpr END AS y
 FROM (SELECT seg, x FROM sg, cr) q ASOF JOIN hv ON q.seg = hv.seg AND q.x >= hv.fpr),
cp AS (SELECT x, min(y) AS common FROM hc GROUP BY x ORDER BY round(min(y) - x, 12) DESC, x LIMIT 1),
po AS (SELECT seg, x AS fpr, common AS tpr, t1 AS t_low, t AS t_high, mix, CASE WHEN y - common > 1e-12 THEN (y - common) / (y - x) ELSE 0 END AS ignore FROM hc JOIN cp USING (x)),
de AS (SELECT po.*, y, ignore * fpr + (1 - ignore) * (mix * CAST(p1 >= t_low AS INT) + (1 - mix) * CAST(p1 >= t_high AS INT)) AS q FROM cohort JOIN po USING (seg))"""


@query(
    f"""WITH {COHORT}, {_MEET} SELECT seg, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, round(t_low, 6) AS t_low, round(t_high, 6) AS t_high, round(mix, 6) AS mix, round(ignore, 6) AS ignore,
 round(avg(q) FILTER (y = 1), 6) AS reached_tpr, round(avg(q) FILTER (y = 0), 6) AS reached_fpr FROM de GROUP BY seg, fpr, tpr, t_low, t_high, mix, ignore"""
)
def group_threshold_eo(spark, sf):
    """The policy of each group, and the rates that its decisions reach on the rows."""
    df = order_cohort(spark, sf)
    policy = materialize(T.group_threshold_eo(df, "seg", "y", "p1"), "policy")
    q = T.group_decision(df, policy, "seg", "p1").groupBy("seg").agg(
        F.avg(F.when(F.col("y") == 1, F.col("q_decision"))).alias("reached_tpr"), F.avg(F.when(F.col("y") == 0, F.col("q_decision"))).alias("reached_fpr")
    )
    return rounded(policy.join(q, "seg"))


@query()
def exp_gradient(spark, sf):
    """Selection, TPR and FPR of the mixture on the years it was fitted on, and on the others."""
    df, fit = _frames(spark, sf)
    out = D.exp_gradient(df, fit, COLS, "y", "seg", constraint="eo", eps=0.02, rounds=4)
    rate = [F.avg(F.when(F.col("y") == v, F.col("q_decision"))).alias(n) for v, n in ((1, "tpr"), (0, "fpr"))]
    return out.groupBy("seg", (F.col("survey_year") <= 1997).alias("fitted")).agg(F.count("*").alias("n"), F.avg("q_decision").alias("selection_rate"), *rate)


@query()
def score_frozen_policy(spark, sf):
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.feature import VectorAssembler

    from ..sources.tabular import scratch

    df, fit = _frames(spark, sf)
    df, fit = (x.withColumn("label", F.col("y").cast("double")).withColumn("weight", F.lit(1.0)) for x in (df, fit))
    stages = [VectorAssembler(inputCols=["p1", "p2", "price"], outputCol="features"), L.classifier("lr", 3)]
    path = scratch(spark, "policy")
    Pipeline(stages=stages).fit(fit).write().save(path)
    scored = L.positive_probability(PipelineModel.load(path).transform(df))
    return scored.groupBy("survey_year").agg(F.round(F.avg("p_event"), 4).alias("mean"), F.round(F.avg((F.col("p_event") >= 0.33).cast("double")), 4).alias("selected"))
