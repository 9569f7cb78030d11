"""Design-based inference, multiplicity and selection; two models on the domain of the year 2000."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cohort import order_cohort
from ..functions.columns import rounded
from ..functions.special import t_ppf
from ..operators import inference as I
from .registry import COHORT, query

GROUPS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
B, DF, SLOTS = 200, 20, 2 * (2 + 3 * len(GROUPS))
TJ, T1 = I.bonferroni_t(0.05, SLOTS, DF), t_ppf(0.975, DF)

_RATES = ["('TPR', y = 1)", "('FPR', y = 0)"]
_FLAGS = " UNION ALL ".join(
    ["SELECT *, 'TPR' AS rate, y = 1 AS flag FROM mo", "SELECT *, 'FPR', y = 0 FROM mo"]
    + [f"SELECT *, '{k}:{g}', seg = '{g}'{c} FROM mo" for k, c in (("SR", ""), ("TPR", " AND y = 1"), ("FPR", " AND y = 0")) for g in GROUPS]
)
_TOT = f"""{COHORT}, mo AS (SELECT stratum, psu, seg, y, CASE WHEN survey_year = 2000 THEN w ELSE 0 END AS w, 'a' AS model, p1 AS q FROM cohort
 UNION ALL SELECT stratum, psu, seg, y, CASE WHEN survey_year = 2000 THEN w ELSE 0 END, 'b', p2 FROM cohort),
fl AS ({_FLAGS}), tot AS (SELECT model, stratum, psu, rate, sum(CASE WHEN flag THEN w * q ELSE 0 END) AS num, sum(CASE WHEN flag THEN w ELSE 0 END) AS den FROM fl GROUP BY 1, 2, 3, 4),
ra AS (SELECT model, rate, sum(num) / nullif(sum(den), 0) AS value, sum(den) AS d FROM tot GROUP BY 1, 2)"""
_SC = f"""{_TOT}, sc AS (SELECT model, stratum, psu, rate, coalesce((num - value * den) / nullif(d, 0), 0) AS t FROM tot JOIN ra USING (model, rate)),
ce AS (SELECT *, t - avg(t) OVER (PARTITION BY model, stratum, rate) AS c, count(*) OVER (PARTITION BY model, stratum, rate) AS n FROM sc),
va AS (SELECT model, rate, sum(n / (n - 1) * c * c) AS var FROM ce GROUP BY 1, 2),
bd AS (SELECT model, rate, value, sqrt(var) AS se, greatest(value - {TJ!r} * sqrt(var), 0) AS lo, least(value + {TJ!r} * sqrt(var), 1) AS hi FROM ra JOIN va USING (model, rate))"""


def totals(spark, sf):
    models = {"a": F.col("p1"), "b": F.col("p2")}
    return I.psu_totals(order_cohort(spark, sf), GROUPS, models, F.col("survey_year") == 2000)


@query(f"WITH {_TOT} SELECT model, stratum, psu, rate, round(num + 3.3e-9, 6) AS num, round(den + 3.3e-9, 6) AS den FROM tot")
def psu_totals(spark, sf):
    # shifted a little, so that no value lies on a rounding border
    return totals(spark, sf).withColumns({c: F.round(F.col(c) + 3.3e-9, 6) for c in ("num", "den")})


@query(f"WITH {_SC} SELECT model, stratum, psu, rate, round(t, 9) AS t FROM sc")
def taylor_rate_scores(spark, sf):
    return I.taylor_scores(totals(spark, sf)).withColumn("t", F.round("t", 9))


@query(
    f"""WITH {_SC} SELECT a.model, a.rate AS rate_a, b.rate AS rate_b, round(1000 * sum(a.n / (a.n - 1) * a.c * b.c), 6) AS cov1000
 FROM ce a JOIN ce b ON a.model = b.model AND a.stratum = b.stratum AND a.psu = b.psu AND a.rate <= b.rate GROUP BY 1, 2, 3"""
)
def taylor_covariance(spark, sf):
    out = I.taylor_covariance(I.taylor_scores(totals(spark, sf)))
    return rounded(out.select("model", "rate_a", "rate_b", (F.col("cov") * 1000).alias("cov1000")))


@query(f"WITH {_SC} SELECT model, rate, round(value, 6) AS value, round(se, 6) AS se, round(lo, 6) AS lo, round(hi, 6) AS hi FROM bd")
def taylor_intervals(spark, sf):
    return rounded(I.bands(totals(spark, sf), TJ))


_GP = """gp AS (SELECT model, string_split(rate, ':')[1] AS kind, greatest(max(lo) - min(hi), 0) AS glo, least(max(hi) - min(lo), 1) AS ghi FROM bd WHERE rate LIKE '%:%' GROUP BY 1, 2),
gi AS (SELECT model, max(CASE WHEN kind = 'SR' THEN glo END) AS dp_lo, max(CASE WHEN kind = 'SR' THEN ghi END) AS dp_hi,
 max(CASE WHEN kind <> 'SR' THEN glo END) AS eo_lo, max(CASE WHEN kind <> 'SR' THEN ghi END) AS eo_hi FROM gp GROUP BY model)"""


@query(f"WITH {_SC}, {_GP} SELECT model, round(dp_lo, 6) AS dp_lo, round(dp_hi, 6) AS dp_hi, round(eo_lo, 6) AS eo_lo, round(eo_hi, 6) AS eo_hi FROM gi")
def gap_projection(spark, sf):
    return rounded(I.gap_projection(I.bands(totals(spark, sf), TJ)))


_BA = """b1 AS (SELECT model, stratum, psu, sum(CASE WHEN rate = 'TPR' THEN 0.5 ELSE -0.5 END * t) AS t FROM {sc} WHERE rate IN ('TPR', 'FPR') GROUP BY 1, 2, 3),
b2 AS (SELECT *, t - avg(t) OVER (PARTITION BY model, stratum) AS c, count(*) OVER (PARTITION BY model, stratum) AS n FROM b1),
b3 AS (SELECT model, sqrt(sum(n / (n - 1) * c * c)) AS se FROM b2 GROUP BY 1)"""


@query(
    f"""WITH {_SC}, {_BA.format(sc='sc')}, v AS (SELECT model, sum(CASE WHEN rate = 'TPR' THEN 0.5 ELSE -0.5 END * value) + 0.5 AS ba FROM ra WHERE rate IN ('TPR', 'FPR') GROUP BY 1)
SELECT model, round(ba, 6) AS ba, round(se, 6) AS se, round(greatest(ba - {T1!r} * se, 0), 6) AS lo, round(least(ba + {T1!r} * se, 1), 6) AS hi FROM v JOIN b3 USING (model)"""
)
def taylor_ba(spark, sf):
    return rounded(I.taylor_ba(totals(spark, sf), T1))


@query(
    f"""WITH {COHORT}, mo AS (SELECT stratum, psu, seg, y, CASE WHEN survey_year = 2000 THEN w ELSE 0 END AS w, 'a-b' AS model, p1 - p2 AS q FROM cohort),
fl AS (SELECT *, 'TPR' AS rate, y = 1 AS flag FROM mo UNION ALL SELECT *, 'FPR', y = 0 FROM mo),
tot AS (SELECT model, stratum, psu, rate, sum(CASE WHEN flag THEN w * q ELSE 0 END) AS num, sum(CASE WHEN flag THEN w ELSE 0 END) AS den FROM fl GROUP BY 1, 2, 3, 4),
ra AS (SELECT model, rate, sum(num) / sum(den) AS value, sum(den) AS d FROM tot GROUP BY 1, 2),
sc AS (SELECT model, stratum, psu, rate, (num - value * den) / d AS t FROM tot JOIN ra USING (model, rate)), {_BA.format(sc='sc')},
v AS (SELECT model, sum(CASE WHEN rate = 'TPR' THEN 0.5 ELSE -0.5 END * value) AS ba FROM ra GROUP BY 1)
SELECT model, round(ba, 6) AS ba, round(se, 6) AS se, round(ba - {T1!r} * se, 6) AS lo, round(ba + {T1!r} * se, 6) AS hi FROM v JOIN b3 USING (model)"""
)
def taylor_paired(spark, sf):
    t = I.psu_totals(order_cohort(spark, sf), GROUPS, {"a-b": F.col("p1") - F.col("p2")}, F.col("survey_year") == 2000)
    return rounded(I.taylor_ba(t, T1, centre=0.0))


_H1 = "((r.b * 7919 + s.stratum * 104729 + d.d * 1299709) % 1000003)"
_FAC = f"""ps AS (SELECT stratum, psu, row_number() OVER (PARTITION BY stratum ORDER BY psu) - 1 AS i FROM (SELECT DISTINCT stratum, psu FROM cohort)),
sz AS (SELECT stratum, count(*) AS n FROM ps GROUP BY 1),
dr AS (SELECT r.b AS replicate, s.stratum, s.n, CAST(floor((({_H1} * {_H1} + d.d * 31 + r.b) % 1000003) * s.n / 1000003) AS BIGINT) AS i
 FROM sz s, (SELECT unnest(range(1, {B + 1})) AS b) r, (SELECT unnest(range(1, 100)) AS d) d WHERE d.d <= s.n - 1),
fa AS (SELECT replicate, stratum, psu, n / (n - 1) * count(*) AS factor FROM dr JOIN ps USING (stratum, i) GROUP BY replicate, stratum, psu, n)"""
_REP = f"""{_TOT}, {_FAC}, rv AS (SELECT replicate, model, rate, sum(factor * num) / nullif(sum(factor * den), 0) AS v FROM fa JOIN tot USING (stratum, psu) GROUP BY 1, 2, 3),
rk AS (SELECT count(DISTINCT rate) FILTER (rate LIKE 'SR:%') AS sr, count(DISTINCT rate) FILTER (rate LIKE 'TPR:%' OR rate LIKE 'FPR:%') AS pr FROM tot),
rm AS (SELECT replicate, model, (max(CASE WHEN rate = 'TPR' THEN v END) + 1 - max(CASE WHEN rate = 'FPR' THEN v END)) / 2 AS ba,
 CASE WHEN count(v) FILTER (rate LIKE 'SR:%') = any_value(sr) THEN max(CASE WHEN rate LIKE 'SR:%' THEN v END) - min(CASE WHEN rate LIKE 'SR:%' THEN v END) END AS dp,
 CASE WHEN count(v) FILTER (rate LIKE 'TPR:%' OR rate LIKE 'FPR:%') = any_value(pr) THEN greatest(max(CASE WHEN rate LIKE 'TPR:%' THEN v END) - min(CASE WHEN rate LIKE 'TPR:%' THEN v END),
 max(CASE WHEN rate LIKE 'FPR:%' THEN v END) - min(CASE WHEN rate LIKE 'FPR:%' THEN v END)) END AS eo FROM rv, rk GROUP BY 1, 2),
pm AS (SELECT model, (max(CASE WHEN rate = 'TPR' THEN value END) + 1 - max(CASE WHEN rate = 'FPR' THEN value END)) / 2 AS ba,
 max(CASE WHEN rate LIKE 'SR:%' THEN value END) - min(CASE WHEN rate LIKE 'SR:%' THEN value END) AS dp,
 greatest(max(CASE WHEN rate LIKE 'TPR:%' THEN value END) - min(CASE WHEN rate LIKE 'TPR:%' THEN value END), max(CASE WHEN rate LIKE 'FPR:%' THEN value END) - min(CASE WHEN rate LIKE 'FPR:%' THEN value END)) AS eo FROM ra GROUP BY 1)"""
_LR = "lr AS (SELECT replicate, model, 'ba' AS metric, ba AS v FROM rm UNION ALL SELECT replicate, model, 'dp', dp FROM rm UNION ALL SELECT replicate, model, 'eo', eo FROM rm), lp AS (SELECT model, 'ba' AS metric, ba AS point FROM pm UNION ALL SELECT model, 'dp', dp FROM pm UNION ALL SELECT model, 'eo', eo FROM pm)"


def replicate_metrics(spark, sf):
    return I.bootstrap_metrics(totals(spark, sf), I.bootstrap_factors(order_cohort(spark, sf), B))


@query(f"WITH {COHORT}, {_FAC} SELECT CAST(replicate AS INT) AS replicate, stratum, psu, round(factor, 6) AS factor FROM fa")
def psu_bootstrap_factors(spark, sf):
    return rounded(I.bootstrap_factors(order_cohort(spark, sf), B))


@query(f"WITH {_REP} SELECT CAST(replicate AS INT) AS replicate, model, round(ba, 6) AS ba, round(dp, 6) AS dp, round(eo, 6) AS eo FROM rm")
def psu_bootstrap_metrics(spark, sf):
    return rounded(replicate_metrics(spark, sf))


@query(
    f"""WITH {_REP}, {_LR}, s AS (SELECT model, metric, stddev_samp(v) AS se, count(v) AS finite FROM lr GROUP BY 1, 2)
SELECT model, metric, round(point, 6) AS point, finite, round(se, 6) AS se, round(point - {T1!r} * se, 6) AS lo, round(point + {T1!r} * se, 6) AS hi, 'VALID' AS status FROM lp JOIN s USING (model, metric)"""
)
def bootstrap_inference(spark, sf):
    t = totals(spark, sf)
    reps = I.bootstrap_metrics(t, I.bootstrap_factors(order_cohort(spark, sf), B))
    return rounded(I.bootstrap_inference(reps, I.point_metrics(t), ["ba", "dp", "eo"], B, DF))


@query(f"WITH {_REP} SELECT y.model, round(stddev_samp(x.ba - y.ba), 6) AS se, round(avg(x.ba - y.ba), 6) AS mean, count(*) AS n FROM rm x JOIN rm y ON x.replicate = y.replicate AND x.model = 'a' AND y.model <> 'a' GROUP BY 1")
def bootstrap_paired(spark, sf):
    return rounded(I.bootstrap_paired(replicate_metrics(spark, sf), "a", "ba"))


_F7 = t_ppf(1 - 0.05 / (2 * 7), DF)


@query(f"WITH {_SC} SELECT model, rate, round(value - {_F7!r} * se, 6) AS lo, round(value + {_F7!r} * se, 6) AS hi FROM bd")
def family_adjusted_interval(spark, sf):
    crit = I.bonferroni_t(0.05, 7, DF)
    b = I.bands(totals(spark, sf), TJ)
    return rounded(b.select("model", "rate", (F.col("value") - crit * F.col("se")).alias("lo"), (F.col("value") + crit * F.col("se")).alias("hi")))


#: Seeds of a candidate: the cohort's residue classes, with a score that mixes both models.
_CAND = f"""{COHORT}, cd AS (SELECT 'c' || k AS candidate, record_key % 3 AS seed, k AS complexity, seg, y, w, CASE WHEN (p1 * (4 - k) + p2 * k) / 4 >= 0.5 THEN 1 ELSE 0 END AS q FROM cohort, (VALUES (0), (1), (2), (3)) v(k)),
cg AS (SELECT candidate, complexity, seed, seg, sum(w * q * y) / sum(w * y) AS tpr, sum(w * q * (1 - y)) / sum(w * (1 - y)) AS fpr FROM cd GROUP BY 1, 2, 3, 4),
co AS (SELECT candidate, seed, (sum(w * q * y) / sum(w * y) + sum(w * (1 - q) * (1 - y)) / sum(w * (1 - y))) / 2 AS ba FROM cd GROUP BY 1, 2),
ce0 AS (SELECT candidate, complexity, seed, greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)) AS eo FROM cg GROUP BY 1, 2, 3),
cs AS (SELECT candidate, complexity, CAST(seed AS INT) AS seed, round(ba, 9) AS ba, round(eo, 9) AS eo, CASE WHEN candidate = 'c2' AND seed = 1 THEN 'FAILED' ELSE 'VALID' END AS status FROM co JOIN ce0 USING (candidate, seed))"""


def candidates(spark, sf):
    """(candidate, complexity, seed) ba, eo, status."""
    df = order_cohort(spark, sf).withColumn("complexity", F.explode(F.array(*[F.lit(k) for k in range(4)])))
    q = ((F.col("p1") * (4 - F.col("complexity")) + F.col("p2") * F.col("complexity")) / 4 >= 0.5).cast("int")
    df = df.select(F.concat(F.lit("c"), "complexity").alias("candidate"), "complexity", (F.col("record_key") % 3).cast("int").alias("seed"), "seg", "y", "w", q.alias("q"))
    from ..operators.metrics import counts, rate_columns

    key = ["candidate", "complexity", "seed"]
    cells = df.groupBy(*key, "seg").agg(*counts(F.col("y"), F.col("q"), F.col("w")))
    r = rate_columns(None)
    groups = cells.withColumns({"tpr": r["TPR"], "fpr": r["FPR"]}).groupBy(*key).agg(F.greatest(F.max("tpr") - F.min("tpr"), F.max("fpr") - F.min("fpr")).alias("eo"))
    total = cells.groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("tp", "tn", "fp", "fn")])
    total = total.select(*key, ((r["TPR"] + r["TNR"]) / 2).alias("ba"))
    failed = (F.col("candidate") == "c2") & (F.col("seed") == 1)
    out = total.join(groups, key).withColumns({"ba": F.round("ba", 9), "eo": F.round("eo", 9)})
    return out.withColumn("status", F.when(failed, "FAILED").otherwise("VALID"))


@query(f"WITH {_CAND} SELECT candidate, round(avg(ba), 6) AS mean, round(stddev_samp(ba), 6) AS sd, round(min(ba), 6) AS min, round(max(ba), 6) AS max FROM cs GROUP BY 1")
def seed_summary(spark, sf):
    return rounded(I.seed_summary(candidates(spark, sf), ["candidate"], "ba"))


_AGG = "ag AS (SELECT candidate, complexity, CASE WHEN count(DISTINCT seed) < 3 THEN 'INCOMPLETE_SEEDS' WHEN count(*) FILTER (status <> 'VALID') > 0 THEN 'INCOMPLETE_INVALID' ELSE 'VALID' END AS status, avg(ba) AS b, avg(eo) AS e FROM cs GROUP BY 1, 2), ac AS (SELECT candidate, complexity, status, CASE WHEN status = 'VALID' THEN b END AS ba, CASE WHEN status = 'VALID' THEN e END AS eo FROM ag)"


@query(f"WITH {_CAND}, {_AGG} SELECT candidate, complexity, status, round(ba, 6) AS ba, round(eo, 6) AS eo FROM ac")
def aggregate_seeds(spark, sf):
    return rounded(I.aggregate_seeds(candidates(spark, sf), ["candidate", "complexity"], 3, ["ba", "eo"]))


def _select_sql(source: str, key: str, tau: float) -> str:
    return f"""SELECT {key}, candidate, round(ba, 6) AS ba, round(eo, 6) AS eo, CASE WHEN eo <= {tau} THEN 'FEASIBLE' ELSE 'NO_FEASIBLE_CONFIGURATION' END AS status FROM {source} WHERE ba IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY eo <= {tau} DESC, CASE WHEN eo <= {tau} THEN -ba ELSE eo END, CASE WHEN eo <= {tau} THEN eo ELSE -ba END, complexity, candidate) = 1"""


@query(f"WITH {_CAND} {_select_sql('cs', 'seed', 0.06)}")
def select_constrained(spark, sf):
    return rounded(I.select_constrained(candidates(spark, sf), ["seed"], 0.06))


@query(f"WITH {_CAND}, {_AGG}, tw AS (SELECT *, tau FROM ac, (VALUES ('0.02'), ('0.2')) t(tau)) " + " UNION ALL ".join(_select_sql(f"(SELECT * FROM tw WHERE tau = '{t}')", "tau", float(t)) for t in ("0.02", "0.2")).replace("SELECT tau, candidate", "(SELECT tau, candidate", 1).replace(" UNION ALL SELECT tau", ") UNION ALL (SELECT tau", 1) + ")")
def select_aggregate(spark, sf):
    means = I.aggregate_seeds(candidates(spark, sf), ["candidate", "complexity"], 3, ["ba", "eo"])
    parts = [I.select_constrained(means.withColumn("tau", F.lit(t)), ["tau"], float(t)) for t in ("0.02", "0.2")]
    return rounded(parts[0].unionByName(parts[1]))


_PV = "pv AS (SELECT prio AS family, seg || '|' || bal_hi AS label, CASE WHEN seg = 'BUILDING' THEN NULL ELSE round(abs(avg(p1) - avg(p2)), 9) END AS p FROM cohort GROUP BY prio, seg, bal_hi)"


@query(
    f"""WITH {COHORT}, {_PV}, o AS (SELECT *, coalesce(p, 1) AS q, row_number() OVER (PARTITION BY family ORDER BY coalesce(p, 1), label) AS r, count(*) OVER (PARTITION BY family) AS n FROM pv),
s AS (SELECT *, least(1, q * (n - r + 1)) AS s FROM o) SELECT family, label, round(p, 6) AS p, round(max(s) OVER (PARTITION BY family ORDER BY r), 6) AS p_holm FROM s"""
)
def holm_adjust(spark, sf):
    d = F.round(F.abs(F.avg("p1") - F.avg("p2")), 9)
    pv = order_cohort(spark, sf).groupBy(F.col("prio").alias("family"), F.concat_ws("|", "seg", "bal_hi").alias("label"), "seg").agg(d.alias("p"))
    pv = pv.withColumn("p", F.when(F.col("seg") != "BUILDING", F.col("p"))).drop("seg")
    return rounded(I.holm_adjust(pv, ["family"], "p", "label"))


_SIM = f"""{_REP}, {_LR}, lg AS (SELECT replicate, model || ':' || metric AS label, v FROM lr WHERE replicate NOT IN (SELECT replicate FROM lr WHERE v IS NULL)),
st AS (SELECT label, stddev_samp(v) AS se, avg(v) AS m FROM lg GROUP BY 1), wz AS (SELECT replicate, max(abs(v - m) / se) AS z FROM lg JOIN st USING (label) GROUP BY 1),
zz AS (SELECT list_sort(list(z)) AS zs FROM wz), c0 AS (SELECT zs, {[t_ppf(0.975, k) for k in range(1, B)]!r}[len(zs) - 1] AS t FROM zz),
c1 AS (SELECT t, greatest(zs[CAST(ceil((len(zs) - 1) * CAST(0.95 AS DOUBLE) - 1e-12) AS BIGINT) + 1], t) AS c FROM c0),
si AS (SELECT label, point, se, point - t * se AS lo, point + t * se AS hi, point - c * se AS sim_lo, point + c * se AS sim_hi FROM lp JOIN st ON st.label = model || ':' || metric, c1)"""


def _simultaneous(spark, sf):
    t = totals(spark, sf)
    reps = I.bootstrap_metrics(t, I.bootstrap_factors(order_cohort(spark, sf), B))
    label = F.concat_ws(":", "model", "metric")

    def long(df, name):
        return df.select(*[c for c in ("replicate", "model") if c in df.columns], F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias(name)) for m in ("ba", "dp", "eo")])))

    r = long(reps, "v").select("replicate", label.alias("label"), "v")
    p = long(I.point_metrics(t), "point").select(label.alias("label"), "point")
    return I.simultaneous_intervals(r, p, 0.05, lambda df: t_ppf(0.975, df))


@query(f"WITH {_SIM} SELECT label, round(point, 6) AS point, round(se, 6) AS se, round(lo, 6) AS lo, round(hi, 6) AS hi, round(sim_lo, 6) AS sim_lo, round(sim_hi, 6) AS sim_hi FROM si")
def simultaneous_replicate_intervals(spark, sf):
    return rounded(_simultaneous(spark, sf))


#: Contrasts of each group against the whole, by year, with an interval of two standard errors.
_CON = """cn AS (SELECT seg, survey_year, avg(p1 - CAST(0.5 AS DOUBLE)) AS point, 2 * stddev_samp(p1) / sqrt(count(*)) AS half FROM cohort GROUP BY 1, 2),
ct AS (SELECT seg, survey_year, round(point, 9) AS point, round(point - half, 9) AS lo, round(point + half, 9) AS hi FROM cn),
cc AS (SELECT *, CASE WHEN lo >= -0.02 AND hi <= 0.02 THEN 'WITHIN' WHEN lo > 0.02 OR hi < -0.02 THEN 'EXCEEDS' ELSE 'INSUFFICIENT' END AS state FROM ct)"""


def contrasts(spark, sf):
    x = F.col("p1") - 0.5
    c = order_cohort(spark, sf).groupBy("seg", "survey_year").agg(F.avg(x).alias("point"), (2 * F.stddev_samp("p1") / F.sqrt(F.count("*"))).alias("half"))
    return c.select("seg", "survey_year", F.round("point", 9).alias("point"), F.round(F.col("point") - F.col("half"), 9).alias("lo"), F.round(F.col("point") + F.col("half"), 9).alias("hi"))


@query(
    f"""WITH {COHORT}, {_CON} SELECT survey_year, round(max(abs(point)), 6) AS point, round(max(CASE WHEN lo <= 0 AND hi >= 0 THEN 0 ELSE least(abs(lo), abs(hi)) END), 6) AS lo,
 round(max(greatest(abs(lo), abs(hi))), 6) AS hi FROM ct GROUP BY survey_year"""
)
def max_abs_projection(spark, sf):
    return rounded(I.max_abs_projection(contrasts(spark, sf), ["survey_year"]))


def _classed(spark, sf):
    return contrasts(spark, sf).withColumn("state", I.tolerance_class(F.col("lo"), F.col("hi"), 0.02))


@query(f"WITH {COHORT}, {_CON} SELECT seg, survey_year, state FROM cc")
def tolerance_class(spark, sf):
    return _classed(spark, sf).select("seg", "survey_year", "state")


_ORDER = "CASE state WHEN 'EXCEEDS' THEN 3 WHEN 'INSUFFICIENT' THEN 2 ELSE 1 END"


@query(f"WITH {COHORT}, {_CON} SELECT survey_year, arg_max(state, {_ORDER}) AS state FROM cc GROUP BY survey_year")
def scope_state(spark, sf):
    return I.scope_state(_classed(spark, sf), ["survey_year"], "state")


@query(f"WITH {COHORT}, {_CON}, s AS (SELECT survey_year, arg_max(state, {_ORDER}) AS state FROM cc GROUP BY 1) SELECT survey_year, lag(state) OVER (ORDER BY survey_year) AS before, state AS after, coalesce(lag(state) OVER (ORDER BY survey_year) <> state, false) AS changed FROM s")
def state_change(spark, sf):
    from pyspark.sql import Window

    s = I.scope_state(_classed(spark, sf), ["survey_year"], "state")
    before = F.lag("state").over(Window.orderBy("survey_year"))  # a row per year
    return s.select("survey_year", before.alias("before"), F.col("state").alias("after"), F.coalesce(before != F.col("state"), F.lit(False)).alias("changed"))


@query(
    f"""WITH {COHORT}, {_CON} SELECT seg, survey_year, round((hi - lo) / 2, 6) AS half_width, round(greatest(point - lo, hi - point), 6) AS margin,
 round(CASE WHEN lo <= 0 AND hi >= 0 THEN 0 ELSE least(abs(lo), abs(hi)) END, 6) AS smallest, round(greatest(abs(lo), abs(hi)), 6) AS largest,
 CASE WHEN greatest(abs(lo), abs(hi)) <= 0.02 THEN 'RULES_OUT_ABOVE_DELTA' WHEN lo > 0.02 OR hi < -0.02 THEN 'RULES_OUT_WITHIN_TOLERANCE' ELSE 'CROSSES_A_BOUNDARY' END AS statement FROM ct"""
)
def precision_diagnostics(spark, sf):
    out = I.precision_diagnostics(contrasts(spark, sf), 0.02)
    return rounded(out.select("seg", "survey_year", "half_width", "margin", "smallest", "largest", "statement"))


_TR = """tr AS (SELECT survey_year, round(avg(p1 - p2), 9) AS gap, round(avg(CASE WHEN seg = 'BUILDING' THEN p1 - p2 END), 9) AS low, round(avg(CASE WHEN seg = 'MACHINERY' THEN p2 - p1 END), 9) AS high, avg(p2) > CAST(0.495 AS DOUBLE) AS worse FROM cohort GROUP BY 1)"""


@query(
    f"""WITH {COHORT}, {_TR} SELECT survey_year, CASE WHEN low < 0 AND high < 0 THEN 'ALL_GROUPS_WORSE' WHEN gap < 0 AND low > 0 AND worse THEN 'TARGET_O_IMPROVED_OTHER_O_WORSENED'
 WHEN gap < 0 AND low > 0 THEN 'GAP_NARROWED_DISADVANTAGED_GROUP_IMPROVED' WHEN gap < 0 AND high < 0 AND NOT low > 0 THEN 'GAP_NARROWED_BY_ADVANTAGED_GROUP_LOSS' ELSE 'NO_PREDECLARED_IMPROVEMENT_PATTERN' END AS category FROM tr"""
)
def tradeoff_class(spark, sf):
    def part(c):
        return F.round(F.avg(c), 9)

    d = F.col("p1") - F.col("p2")
    t = order_cohort(spark, sf).groupBy("survey_year").agg(
        part(d).alias("gap"), part(F.when(F.col("seg") == "BUILDING", d)).alias("low"), part(F.when(F.col("seg") == "MACHINERY", -d)).alias("high"), (F.avg("p2") > 0.495).alias("worse")
    )
    return t.select("survey_year", I.tradeoff_class(F.col("gap"), F.col("low"), F.col("high"), F.col("worse")).alias("category"))
