"""Divergences, distances and concentration on the cohort."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cohort import order_cohort
from ..functions.columns import rounded
from ..operators import geometry as G
from ..operators import ranking as R
from .registry import COHORT, LONG, query

ATTRS, CATS, NUMS = ["seg", "bal_hi"], ["prio", "n_lines"], ["price", "acctbal", "avg_disc"]

_CELLS = """cl AS (SELECT attr, grp, feature, category, count(*) AS n, {w} AS sw FROM (SELECT attr, grp, w, 'prio' AS feature, prio AS category FROM long UNION ALL
 SELECT attr, grp, w, 'n_lines', CAST(n_lines AS VARCHAR) FROM long) WHERE category IS NOT NULL AND grp IS NOT NULL GROUP BY 1, 2, 3, 4),
sh AS (SELECT *, sw / sum(sw) OVER (PARTITION BY attr, grp, feature) AS p FROM cl),
gr AS (SELECT DISTINCT attr, feature, grp FROM cl), pr AS (SELECT a.attr, a.feature, a.grp AS grp_a, b.grp AS grp_b FROM gr a JOIN gr b ON a.attr = b.attr AND a.feature = b.feature AND a.grp < b.grp),
pc AS (SELECT pr.attr, pr.feature, grp_a, grp_b, category, sum(CASE WHEN grp = grp_a THEN p ELSE 0 END) AS pa, sum(CASE WHEN grp = grp_b THEN p ELSE 0 END) AS pb,
 sum(CASE WHEN grp = grp_a THEN sw ELSE 0 END) AS na, sum(CASE WHEN grp = grp_b THEN sw ELSE 0 END) AS nb
 FROM pr JOIN sh ON sh.attr = pr.attr AND sh.feature = pr.feature AND (sh.grp = grp_a OR sh.grp = grp_b) GROUP BY 1, 2, 3, 4, 5),
cat AS (SELECT attr, grp_a, grp_b, feature, sum(abs(pa - pb)) / count(*) AS g, sum(pow(na - nb, 2) / (na + nb)) / 2 AS gb FROM pc GROUP BY 1, 2, 3, 4)"""
_MOM = """mm AS (SELECT attr, grp, feature, {m} AS mean, min(x) AS lo, max(x) AS hi FROM (SELECT attr, grp, w, 'price' AS feature, price AS x FROM long UNION ALL
 SELECT attr, grp, w, 'acctbal', acctbal FROM long UNION ALL SELECT attr, grp, w, 'avg_disc', avg_disc FROM long) WHERE x IS NOT NULL GROUP BY 1, 2, 3),
num AS (SELECT a.attr, a.grp AS grp_a, b.grp AS grp_b, a.feature, abs(a.mean - b.mean) / (greatest(a.hi, b.hi) - least(a.lo, b.lo)) AS g FROM mm a JOIN mm b ON a.attr = b.attr AND a.feature = b.feature AND a.grp < b.grp)"""
_C, _M = _CELLS.format(w="count(*)"), _MOM.format(m="avg(x)")
_CW, _MW = _CELLS.format(w="sum(w)"), _MOM.format(m="sum(w * x) / sum(w)")
_G = "g AS (SELECT attr, grp_a, grp_b, feature, g FROM cat UNION ALL SELECT attr, grp_a, grp_b, feature, g FROM num)"


def divergences(df, w=None):
    return G.div_cat(G.cells(df, ATTRS, CATS, w)).unionByName(G.div_num(G.moments(df, ATTRS, NUMS, w)))


@query(f"WITH {LONG}, {_C} SELECT attr, grp_a, grp_b, feature, round(g, 6) AS g FROM cat")
def div_cat_a(spark, sf):
    return rounded(G.div_cat(G.cells(order_cohort(spark, sf), ATTRS, CATS)))


@query(f"WITH {LONG}, {_C} SELECT attr, grp_a, grp_b, feature, round(gb, 6) AS g FROM cat")
def div_cat_b(spark, sf):
    return rounded(G.div_cat(G.cells(order_cohort(spark, sf), ATTRS, CATS), "b"))


@query(f"WITH {LONG}, {_M} SELECT attr, grp_a, grp_b, feature, round(g, 6) AS g FROM num")
def div_num_a(spark, sf):
    return rounded(G.div_num(G.moments(order_cohort(spark, sf), ATTRS, NUMS)))


@query(
    f"""WITH {COHORT}, v AS (SELECT DISTINCT price FROM cohort), d AS (SELECT price, sum(bal_hi) AS a, sum(1 - bal_hi) AS b FROM cohort GROUP BY price),
c AS (SELECT sum(a) OVER (ORDER BY price) / (SELECT sum(a) FROM d) - sum(b) OVER (ORDER BY price) / (SELECT sum(b) FROM d) AS d FROM d) SELECT round(max(abs(d)), 6) AS ks FROM c"""
)
def div_num_b(spark, sf):
    return rounded(R.ks_two_sample(order_cohort(spark, sf), [], "bal_hi", "price", 0.0, 500_000.0))


@query(
    f"""WITH {COHORT}, r AS (SELECT bal_hi = 1 AS ga, price AS x, max(CASE WHEN bal_hi = 1 THEN price END) OVER u AS a0, max(CASE WHEN bal_hi = 0 THEN price END) OVER u AS b0,
 min(CASE WHEN bal_hi = 1 THEN price END) OVER d AS a1, min(CASE WHEN bal_hi = 0 THEN price END) OVER d AS b1 FROM cohort
 WINDOW u AS (ORDER BY price RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), d AS (ORDER BY price RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT round(avg(CASE WHEN ga THEN least(x - b0, b1 - x) ELSE least(x - a0, a1 - x) END), 6) AS g FROM r"""
)
def div_num_c(spark, sf):
    return rounded(G.div_nearest(order_cohort(spark, sf), "bal_hi", "price", "1", "0"))


@query(f"WITH {LONG}, {_CW}, {_MW}, {_G} SELECT attr, grp_a, grp_b, feature, round(g, 6) AS g FROM g")
def div_weighted(spark, sf):
    return rounded(divergences(order_cohort(spark, sf), "w"))


@query(
    f"""WITH {LONG}, {_C}, {_M}, {_G} SELECT attr, grp_a, grp_b, feature, round(coalesce(g / nullif(avg(g) OVER (PARTITION BY attr, grp_a, grp_b, feature IN ('price', 'acctbal', 'avg_disc')), 0), 0), 6) AS g FROM g"""
)
def div_scale(spark, sf):
    return rounded(G.div_scale(divergences(order_cohort(spark, sf)), F.col("feature").isin(NUMS)))


@query(f"WITH {COHORT} SELECT seg, round(sum(w), 6) AS total, count(*) FILTER (w IS NULL OR w < 0) AS bad, 'PASS' AS status FROM cohort GROUP BY seg")
def weights_validate(spark, sf):
    return rounded(G.weights_validate(order_cohort(spark, sf), "seg", "w"))


@query(f"WITH {LONG}, {_C}, {_M}, {_G} SELECT attr, grp_a, grp_b, round(sqrt(avg(g * g)), 6) AS w FROM g GROUP BY 1, 2, 3")
def w_max(spark, sf):
    return rounded(G.w_max(divergences(order_cohort(spark, sf)), ["attr", "grp_a", "grp_b"]))


@query(
    f"""WITH {LONG}, {_C}, {_M}, {_G}, f AS (SELECT DISTINCT feature FROM g) SELECT '' AS context, 0 AS k UNION ALL SELECT feature, 1 FROM f
 UNION ALL SELECT a.feature || '+' || b.feature, 2 FROM f a JOIN f b ON a.feature < b.feature
 UNION ALL SELECT a.feature || '+' || b.feature || '+' || c.feature, 3 FROM f a JOIN f b ON a.feature < b.feature JOIN f c ON b.feature < c.feature"""
)
def exclusion_contexts(spark, sf):
    return G.exclusion_contexts(divergences(order_cohort(spark, sf)).select("feature").distinct(), 3)


#: Distances by enumerating every context, not by the closed form.
_ENUM = """fs AS (SELECT DISTINCT attr, feature FROM g), nodes AS (SELECT attr, feature FROM fs UNION ALL SELECT DISTINCT attr, 'origin' FROM fs),
np AS (SELECT a.attr, a.feature AS node_a, b.feature AS node_b FROM nodes a JOIN nodes b ON a.attr = b.attr AND a.feature <> 'origin' AND (b.feature = 'origin' OR a.feature < b.feature)),
cx AS (SELECT np.attr, node_a, node_b, o.feature AS out FROM np JOIN (SELECT attr, feature FROM fs UNION ALL SELECT DISTINCT attr, '' FROM fs) o ON o.attr = np.attr AND o.feature <> node_a AND o.feature <> node_b),
sv AS (SELECT cx.attr, node_a, node_b, out, grp_a, grp_b,
 coalesce(sqrt(sum(CASE WHEN feature <> node_b AND feature <> out THEN g * g END) / nullif(count(*) FILTER (feature <> node_b AND feature <> out), 0)), 0) AS v1,
 coalesce(sqrt(sum(CASE WHEN feature <> node_a AND feature <> out THEN g * g END) / nullif(count(*) FILTER (feature <> node_a AND feature <> out), 0)), 0) AS v2
 FROM cx JOIN g ON g.attr = cx.attr GROUP BY 1, 2, 3, 4, 5, 6)"""
_MEAN = _ENUM + """, pm AS (SELECT attr, node_a, node_b, out, avg(abs(v1 - v2)) AS v FROM sv GROUP BY 1, 2, 3, 4), dist AS (SELECT attr, node_a, node_b, avg(v) AS d FROM pm GROUP BY 1, 2, 3)"""
_MAX = _ENUM + """, pm AS (SELECT attr, node_a, node_b, out, abs(max(v1) - max(v2)) AS v FROM sv GROUP BY 1, 2, 3, 4), dist AS (SELECT attr, node_a, node_b, avg(v) AS d FROM pm GROUP BY 1, 2, 3)"""
_BASE = f"{LONG}, {_C}, {_M}, {_G}, {_MEAN}"


def _dist(spark, sf, aggregate="mean_pair"):
    return G.distances(divergences(order_cohort(spark, sf)), ["attr"], aggregate)


@query(f"WITH {_BASE} SELECT attr, node_a, node_b, round(d, 6) AS d FROM dist WHERE node_b <> 'origin'")
def pair_distance(spark, sf):
    return rounded(_dist(spark, sf).filter(F.col("node_b") != G.ORIGIN))


@query(f"WITH {_BASE} SELECT attr, node_a, node_b, round(d, 6) AS d FROM dist WHERE node_b = 'origin'")
def origin_distance(spark, sf):
    return rounded(_dist(spark, sf).filter(F.col("node_b") == G.ORIGIN))


#: The same over contexts that leave out up to all other features: every subset by a bit mask.
_SUBSETS = """fs AS (SELECT attr, feature, row_number() OVER (PARTITION BY attr ORDER BY feature) - 1 AS i FROM (SELECT DISTINCT attr, feature FROM g)), nf AS (SELECT attr, count(*) AS n FROM fs GROUP BY 1),
nodes AS (SELECT attr, feature, i FROM fs UNION ALL SELECT attr, 'origin', NULL FROM nf),
np AS (SELECT a.attr, a.feature AS node_a, a.i AS ia, b.feature AS node_b, b.i AS ib FROM nodes a JOIN nodes b ON a.attr = b.attr AND a.feature <> 'origin' AND (b.feature = 'origin' OR a.feature < b.feature)),
mk AS (SELECT attr, unnest(range(0, 1 << n)) AS m FROM nf),
cx AS (SELECT np.*, m FROM np JOIN mk ON mk.attr = np.attr AND (m >> ia) & 1 = 0 AND (ib IS NULL OR (m >> ib) & 1 = 0) AND bit_count(m) <= {most}),
sv AS (SELECT cx.attr, node_a, node_b, m, grp_a, grp_b,
 coalesce(sqrt(avg(CASE WHEN g.feature <> node_b AND (m >> i) & 1 = 0 THEN g * g END)), 0) AS v1, coalesce(sqrt(avg(CASE WHEN g.feature <> node_a AND (m >> i) & 1 = 0 THEN g * g END)), 0) AS v2
 FROM cx JOIN g ON g.attr = cx.attr JOIN fs ON fs.attr = g.attr AND fs.feature = g.feature GROUP BY 1, 2, 3, 4, 5, 6),
pm AS (SELECT attr, node_a, node_b, m, avg(abs(v1 - v2)) AS v FROM sv GROUP BY 1, 2, 3, 4), dist AS (SELECT attr, node_a, node_b, avg(v) AS d FROM pm GROUP BY 1, 2, 3)"""


@query(f"WITH {LONG}, {_C}, {_M}, {_G}, {_SUBSETS.replace('{most}', '2')} SELECT attr, node_a, node_b, round(d, 6) AS d FROM dist WHERE node_b <> 'origin'")
def pair_distance_two_left_out(spark, sf):
    return rounded(G.distances(divergences(order_cohort(spark, sf)), ["attr"], most=2).filter(F.col("node_b") != G.ORIGIN))


@query(f"WITH {LONG}, {_C}, {_M}, {_G}, {_SUBSETS.replace('{most}', '99')} SELECT attr, node_a, node_b, round(d, 6) AS d FROM dist WHERE node_b = 'origin'")
def origin_distance_all_subsets(spark, sf):
    return rounded(G.distances(divergences(order_cohort(spark, sf)), ["attr"], most=99).filter(F.col("node_b") == G.ORIGIN))


@query(f"WITH {LONG}, {_C}, {_M}, {_G}, {_MAX} SELECT attr, node_a, node_b, round(d, 6) AS d FROM dist")
def multigroup_agg(spark, sf):
    return rounded(_dist(spark, sf, "author_max_pair"))


@query()
def dphi(spark, sf):
    return G.embed(_dist(spark, sf), ["attr"]).select("attr", "feature", F.round("dphi", 6).alias("dphi"))


@query()
def dphi_dim_elbow(spark, sf):
    return G.embed(_dist(spark, sf), ["attr"], dims=None).select("attr", "dim", F.round("stress", 6).alias("stress")).distinct()


@query()
def dphi_matrix(spark, sf):
    out = G.embed(_dist(spark, sf), ["attr"])
    return out.groupBy("feature").pivot("attr", ATTRS).agg(F.round(F.first("dphi"), 6))


@query()
def axis_rotation(spark, sf):
    out = G.embed(_dist(spark, sf), ["attr"], rotate=True)
    return out.select("attr", "feature", F.posexplode("coord").alias("axis", "value")).withColumn("value", F.round("value", 6))


@query()
def train_epsilon(spark, sf):
    from ..operators.prep import fit_guard

    df = fit_guard(order_cohort(spark, sf).filter("survey_year <= 1997"), "survey_year", [1995, 1996, 1997])
    return rounded(G.epsilon_ratio(G.embed(G.distances(divergences(df), ["attr"]), ["attr"]), ["attr"], "dphi", 0.5))


@query(f"WITH {_BASE} SELECT attr, round(avg(d) * 0.5, 6) AS epsilon FROM dist WHERE node_b = 'origin' GROUP BY attr")
def epsilon_ratio(spark, sf):
    return rounded(G.epsilon_ratio(_dist(spark, sf).filter(F.col("node_b") == G.ORIGIN), ["attr"], "d", 0.5))


@query(
    f"""WITH {_BASE}, o AS (SELECT attr, d AS v, node_a FROM dist WHERE node_b = 'origin'), r AS (SELECT *, row_number() OVER (PARTITION BY attr ORDER BY v, node_a) AS i, count(*) OVER (PARTITION BY attr) AS n FROM o),
s AS (SELECT a.attr, a.i, round(sum(pow(b.v - CASE WHEN b.i <= a.i THEN (SELECT avg(v) FROM r c WHERE c.attr = a.attr AND c.i <= a.i) ELSE (SELECT avg(v) FROM r c WHERE c.attr = a.attr AND c.i > a.i) END, 2)), 14) AS wcss,
 (SELECT avg(v) FROM r c WHERE c.attr = a.attr AND c.i <= a.i) AS low FROM r a JOIN r b ON a.attr = b.attr WHERE a.i < a.n GROUP BY a.attr, a.i),
m AS (SELECT attr, arg_min(low, wcss) AS m FROM s GROUP BY attr), e AS (SELECT attr, m, pow(10, floor(log10(m))) AS e FROM m)
SELECT attr, round(e * CASE WHEN m / e <= 1 + 1e-9 THEN 1 WHEN m / e <= 2 + 1e-9 THEN 2 WHEN m / e <= 5 + 1e-9 THEN 5 ELSE 10 END, 6) AS epsilon FROM e"""
)
def epsilon_kmeans_125(spark, sf):
    return rounded(G.epsilon_kmeans_125(_dist(spark, sf).filter(F.col("node_b") == G.ORIGIN), ["attr"], "d"))


@query(f"WITH {_BASE} SELECT attr, node_a, round(d, 6) AS d, row_number() OVER (ORDER BY round(d, 9) DESC, attr, node_a) AS rank FROM dist WHERE node_b = 'origin'")
def rank_epsilon(spark, sf):
    from pyspark.sql import Window

    d = _dist(spark, sf).filter(F.col("node_b") == G.ORIGIN).drop("node_b")
    w = Window.orderBy(F.desc(F.round("d", 9)), "attr", "node_a")  # a row per attribute and feature
    return rounded(d.withColumn("rank", F.row_number().over(w)))


@query(f"WITH {_BASE} SELECT attr, round(max(d), 6) AS worst, max(d) <= 0.01 AS feasible FROM dist WHERE node_b = 'origin' GROUP BY attr")
def feasibility(spark, sf):
    d = _dist(spark, sf).filter(F.col("node_b") == G.ORIGIN)
    out = d.groupBy("attr").agg(F.max("d").alias("worst"))
    return rounded(out.withColumn("feasible", F.col("worst").isNotNull() & (F.col("worst") <= 0.01)))


@query(
    f"""WITH {COHORT}, l AS (SELECT seg, 'prio' AS feature, prio AS v FROM cohort UNION ALL SELECT seg, 'avg_disc', CASE WHEN seg <> 'BUILDING' THEN CAST(avg_disc AS VARCHAR) END FROM cohort UNION ALL SELECT seg, 'one', '1' FROM cohort),
p AS (SELECT feature, seg, count(*) AS rows, count(v) AS valid FROM l GROUP BY 1, 2), k AS (SELECT feature, count(DISTINCT v) AS d FROM l GROUP BY 1)
SELECT feature, count(*) AS groups, sum(rows) AS rows, min(valid) AS least_valid, sum(rows - valid) AS missing, any_value(d) AS distinct,
 CASE WHEN count(*) < 2 THEN 'SINGLE_GROUP' WHEN min(valid) = 0 THEN 'EMPTY_GROUP' WHEN any_value(d) < 2 THEN 'CONSTANT' ELSE 'OK' END AS status FROM p JOIN k USING (feature) GROUP BY feature"""
)
def geometry_diagnostics(spark, sf):
    df = order_cohort(spark, sf).withColumn("avg_disc", F.when(F.col("seg") != "BUILDING", F.col("avg_disc"))).withColumn("one", F.lit(1))
    return G.geometry_diagnostics(df, "seg", ["prio", "avg_disc", "one"])


@query(
    f"""WITH {COHORT}, i AS (SELECT seg || '|' || bal_hi AS grp, count(*) AS n, avg(CAST(yhat AS DOUBLE)) AS sr FROM cohort GROUP BY 1)
SELECT grp, n, round(sr, 6) AS selection_rate, round(max(sr) OVER () - min(sr) OVER (), 6) AS dp FROM i"""
)
def intersection_groups(spark, sf):
    from ..operators.metrics import fairness_gaps, group_metrics

    df = order_cohort(spark, sf).withColumn("both", F.concat_ws("|", "seg", "bal_hi"))
    groups = group_metrics(df, ["both"])
    return rounded(groups.join(fairness_gaps(groups).select("attr", "dp"), "attr").select("grp", "n", "selection_rate", "dp"))
