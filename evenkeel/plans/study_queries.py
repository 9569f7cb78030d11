"""Grids, contrasts and whole methods on the cohort."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cohort import order_cohort
from ..functions.columns import rounded
from ..operators import importance as N
from ..operators import inference as I
from ..operators import search as S
from ..operators import study as Y
from ..operators.splits import stratified_split
from ..sources.tabular import materialize
from .inference_queries import _CAND, _GP, _SC, GROUPS, TJ, candidates, totals
from .metric_queries import _AUC, _FG, _GROUPS, groups
from .registry import COHORT, LONG, query

ATTRS = ["seg", "bal_hi"]
_SEEDS = "SELECT candidate AS method, seed, round(ba, 6) AS ba, round(eo, 6) AS eo FROM cs"


@query(
    f"""WITH {COHORT}, d AS (SELECT DISTINCT seg AS arm FROM cohort), g AS (SELECT arm, backbone, tau FROM d, (VALUES ('lr'), ('tree')) b(backbone), (VALUES ('0.02'), ('0.05')) t(tau))
SELECT arm, backbone, tau, sha256(arm || '|' || backbone || '|' || tau) AS candidate_id FROM g"""
)
def candidate_grid(spark, sf):
    arms = order_cohort(spark, sf).select(F.col("seg").alias("arm")).distinct()
    b, t = spark.createDataFrame([("lr",), ("tree",)], "backbone string"), spark.createDataFrame([("0.02",), ("0.05",)], "tau string")
    return Y.candidate_grid([arms, b, t], ["arm", "backbone", "tau"])


@query(
    f"""WITH {LONG}, g AS (SELECT DISTINCT attr, grp FROM long) SELECT attr, grp, endpoint, method, sha256(attr || '|' || grp || '|' || endpoint || '|' || method) AS contrast_id
 FROM g, (VALUES ('tpr'), ('fpr')) e(endpoint), (VALUES ('a'), ('b'), ('c')) m(method)"""
)
def contrast_family(spark, sf):
    return Y.contrast_family(groups(spark, sf), ["tpr", "fpr"], ["a", "b", "c"])


_REG = """cr AS (SELECT a.seed, a.candidate AS reference, b.candidate AS comparison, CASE WHEN a.candidate = 'c0' THEN 'primary' ELSE 'secondary' END AS family FROM cs a JOIN cs b
 ON a.seed = b.seed AND a.candidate <> b.candidate WHERE a.candidate = 'c0' OR (b.candidate <> 'c0' AND a.candidate < b.candidate))"""


def _results(spark, sf):
    return candidates(spark, sf).withColumnRenamed("candidate", "method")


def _registry(spark, sf):
    return Y.contrast_registry(_results(spark, sf).select("seed", "method"), ["seed"], "method", "c0")


@query(f"WITH {_CAND}, {_REG} SELECT * FROM cr")
def contrast_registry(spark, sf):
    return _registry(spark, sf)


@query(
    f"""WITH {_CAND}, {_REG} SELECT cr.*, round(a.ba, 6) AS ba_reference, round(b.ba, 6) AS ba_comparison, round(a.eo, 6) AS eo_reference, round(b.eo, 6) AS eo_comparison, round(b.ba - a.ba, 6) AS d_ba, round(b.eo - a.eo, 6) AS d_eo
 FROM cr JOIN cs a ON a.seed = cr.seed AND a.candidate = reference JOIN cs b ON b.seed = cr.seed AND b.candidate = comparison"""
)
def join_contrast(spark, sf):
    return rounded(Y.join_contrast(_registry(spark, sf), _results(spark, sf), ["seed"], "method", ["ba", "eo"]))


@query(
    f"""WITH {_CAND}, {_REG}, j AS (SELECT family, reference, comparison, b.ba - a.ba AS d FROM cr JOIN cs a ON a.seed = cr.seed AND a.candidate = reference JOIN cs b ON b.seed = cr.seed AND b.candidate = comparison)
SELECT family, reference, comparison, count(*) AS seeds, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS sd, round(min(d), 6) AS min, round(max(d), 6) AS max FROM j GROUP BY 1, 2, 3"""
)
def selection_contrasts(spark, sf):
    joined = Y.join_contrast(_registry(spark, sf), _results(spark, sf), ["seed"], "method", ["ba", "eo"])
    key = ["family", "reference", "comparison"]
    return rounded(I.seed_summary(joined, key, "d_ba").join(joined.groupBy(*key).agg(F.count("*").alias("seeds")), key))


@query(f"WITH {_SC}, {_GP} SELECT 'all' AS family, round(avg(eo_lo), 6) AS lo, round(avg(eo_hi), 6) AS hi FROM gi")
def projection_mean(spark, sf):
    gaps = I.gap_projection(I.bands(totals(spark, sf), TJ))
    return rounded(Y.projection_mean(gaps.select(F.lit("all").alias("family"), F.col("eo_lo").alias("lo"), F.col("eo_hi").alias("hi")), ["family"]))


@query(f"WITH {_SC}, {_GP} SELECT 'eo' AS metric, round(greatest(a.eo_lo - b.eo_hi, -1), 6) AS lo, round(least(a.eo_hi - b.eo_lo, 1), 6) AS hi FROM gi a, gi b WHERE a.model = 'a' AND b.model = 'b'")
def projection_difference(spark, sf):
    gaps = I.gap_projection(I.bands(totals(spark, sf), TJ)).select("model", F.lit("eo").alias("metric"), F.col("eo_lo").alias("lo"), F.col("eo_hi").alias("hi"))
    return rounded(Y.projection_difference(gaps.filter("model = 'a'"), gaps.filter("model = 'b'"), ["metric"]))


_UT = f"""p AS (SELECT p1, sum(y) AS pos, sum(1 - y) AS neg FROM cohort GROUP BY p1),
c AS (SELECT *, sum(neg) OVER (ORDER BY p1) - neg AS below, sum(pos) OVER (ORDER BY p1 DESC) AS tp, sum(neg) OVER (ORDER BY p1 DESC) AS fp, sum(pos) OVER () AS ap FROM p),
u AS (SELECT {_AUC} AS auroc, sum((tp / (tp + fp)) * (pos / ap)) AS ap FROM c),
k AS (SELECT sum(y * yhat) AS tp, sum((1 - y) * yhat) AS fp, sum(y * (1 - yhat)) AS fn, sum((1 - y) * (1 - yhat)) AS tn FROM cohort),
uk AS (SELECT auroc, ap, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS ba, 2 * tp / (2 * tp + fp + fn) AS f1, (tp + tn) / (tp + tn + fp + fn) AS accuracy FROM u, k)"""


@query(
    f"WITH {_GROUPS}, {_FG}, {_UT} "
    + " UNION ALL ".join(f"SELECT 'all' AS scope, '{m}' AS metric, round({m}, 6) AS value FROM uk" for m in ("auroc", "ap", "ba", "f1", "accuracy"))
    + "".join(f" UNION ALL SELECT attr, '{n}', round({v}, 6) FROM fg" for n, v in (("dp", "dp"), ("eopp", "eopp"), ("fpr_gap", "fpr_gap"), ("eo", "greatest(eopp, fpr_gap)")))
)
def evaluate_predictions(spark, sf):
    return rounded(Y.evaluate_predictions(order_cohort(spark, sf), ["seg", "bal_hi"]))


@query(
    f"""WITH {COHORT}, r AS (SELECT record_key, bal_hi, p1, p2 FROM cohort),
n AS (SELECT a.record_key, min(sqrt(pow(a.p1 - b.p1, 2) + pow(a.p2 - b.p2, 2))) AS d FROM r a JOIN r b ON a.bal_hi <> b.bal_hi GROUP BY 1) SELECT round(avg(d), 6) AS g FROM n"""
)
def div_num_d(spark, sf):
    return rounded(Y.nearest_other_group(order_cohort(spark, sf), "bal_hi", "1", "0", ["p1", "p2"]))


@query()
def rank_protected_auto(spark, sf):
    return rounded(Y.rank_protected_auto(order_cohort(spark, sf), ["seg", "bal_hi", "prio"], ["price", "acctbal", "avg_disc"], 2))


def _rows(spark, sf):
    # written once: the split goes over the rows several times, and would join and group the tables anew each time
    return materialize(order_cohort(spark, sf).select("record_key", "y", "seg", "bal_hi", "prio", "price", "acctbal"), "cohort")


def _method(df, method):
    return rounded(Y.benchmark(df, "record_key", ["seg", "bal_hi"], ["prio"], ["price", "acctbal"], "y", method))


@query()
def method_bm(spark, sf):
    return _method(_rows(spark, sf), "bm")


@query()
def method_bm_ae(spark, sf):
    return _method(_rows(spark, sf), "bm_ae")


@query()
def mitigation_pipeline(spark, sf):
    """Baseline and treated evaluation side by side."""
    df = _rows(spark, sf)
    a, b = _method(df, "unmitigated"), _method(df, "bm")
    both = a.select("scope", "metric", F.col("value").alias("before")).join(b.select("scope", "metric", F.col("value").alias("after")), ["scope", "metric"], "full")
    return both.withColumn("delta", F.round(F.col("after") - F.col("before"), 6))


@query()
def benchmark_arm(spark, sf):
    """All methods of one arm on the same test rows, with both kinds of design-based intervals."""
    cols = ["record_key", "y", "seg", "bal_hi", "prio", "price", "acctbal", "w", "stratum", "psu"]
    df = order_cohort(spark, sf).select(*cols)
    decided = materialize(Y.arm_decisions(df, "record_key", "seg", ["seg", "bal_hi"], ["prio"], ["price", "acctbal"], "y", carry=["w", "stratum", "psu"]), "decisions")
    return rounded(Y.arm_inference(decided, list(Y.METHODS), GROUPS, "y", "seg", "w"))


@query()
def mitigation_checkpoints(spark, sf):
    """Validation metrics of each state that the search went through, and the one that the Pareto rule takes."""
    keep = ["record_key", "y", *ATTRS, "split"]
    parts = materialize(stratified_split(order_cohort(spark, sf), ["y"], "record_key").select(*keep, "prio", "price", "acctbal"), "split")
    search = S.Mitigation(parts.filter("split = 'train'"), ATTRS, ["prio"], ["price", "acctbal"], "y", [3.0, 1 / 3, 5.0, 1 / 5], mode="next")
    search.run()
    metrics = materialize(Y.checkpoint_metrics(parts, search.states, ATTRS, ["prio"], ["price", "acctbal"], keep, "y"), "metrics")
    best = Y.pareto_checkpoint(metrics, 0.05).withColumnRenamed("state", "best")
    return rounded(metrics.crossJoin(F.broadcast(best)).select("state", "accuracy", "dp", "eo", (F.col("state") == F.col("best")).alias("taken")))  # one row


@query()
def mitigation_weighted(spark, sf):
    """The search by weighted shares, means and information."""
    search = S.Mitigation(order_cohort(spark, sf), ATTRS, ["prio"], ["price", "acctbal"], "y", [3.0, 1 / 3, 5.0, 1 / 5], mode="next", weight="w")
    search.run()
    return rounded(search.trace_table().withColumn("ended", F.lit(search.status)))


def _importance_parts(spark, sf):
    return stratified_split(order_cohort(spark, sf), ["y"], "record_key").select("record_key", "y", "split", "prio", "seg", "price", "acctbal", "n_lines", "p1")


@query()
def importance_l1(spark, sf):
    found, penalty = N.l1_importance(_importance_parts(spark, sf), "record_key", ["prio", "seg"], ["price", "acctbal", "n_lines", "p1"], "y")
    return rounded(spark.createDataFrame([(f, v, penalty) for f, v in found.items()], "feature string, importance double, penalty double"))


@query()
def importance_permutation(spark, sf):
    return rounded(N.permutation_importance(_importance_parts(spark, sf), "record_key", ["prio", "seg"], ["price", "acctbal", "n_lines", "p1"], "y"))
