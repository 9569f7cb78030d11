"""Preprocessing and transforms on the cohort; the fit partition is the years up to 1997."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cohort import coded_lines, order_cohort, table
from ..functions.columns import rounded, unpivot
from ..operators import geometry as G
from ..operators import prep as P
from ..operators import transforms as X
from .registry import CODED, COHORT, query

FIT = "survey_year <= 1997"


def _fit(df):
    return df.filter(FIT)


def _types(sql_rule: str, cols: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct, CASE WHEN {sql_rule.format(c=c) if k == 'n' else ('true' if k == 't' else ('count(DISTINCT ' + c + ') > 1000000' if k == 's' else 'true'))} THEN 'numerical' ELSE 'categorical' END AS kind FROM orders"
        for c, k in cols
    )


@query(_types("count(DISTINCT {c}) >= 20", [("o_orderkey", "n"), ("o_totalprice", "n"), ("o_orderdate", "t"), ("o_orderpriority", "s"), ("o_orderstatus", "s")]))
def infer_types_legacy(spark, sf):
    return P.infer_types(table(spark, sf, "orders"), ["o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority", "o_orderstatus"], legacy=True)


@query(
    """SELECT 'l_linenumber' AS "column", count(DISTINCT l_linenumber) AS n_distinct, CASE WHEN count(DISTINCT l_linenumber) > 5 THEN 'numerical' ELSE 'categorical' END AS kind FROM lineitem
 UNION ALL SELECT 'l_discount', count(DISTINCT l_discount), 'numerical' FROM lineitem UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag), 'categorical' FROM lineitem"""
)
def infer_types(spark, sf):
    return P.infer_types(table(spark, sf, "lineitem"), ["l_linenumber", "l_discount", "l_returnflag"])


@query(f"WITH {COHORT} SELECT y, seg, bal_hi, survey_year, w, prio, price, acctbal, n_lines, avg_disc, yhat FROM cohort")
def select_roles(spark, sf):
    return P.select_roles(order_cohort(spark, sf), "y", ["seg", "bal_hi"], ["record_key", "stratum", "psu", "p1", "p2"])[1]


@query(f"WITH {COHORT} SELECT record_key, CASE WHEN price > (SELECT quantile_cont(price, 0.5) FROM cohort WHERE {FIT}) THEN 1 ELSE 0 END AS price_bin FROM cohort")
def median_binarize(spark, sf):
    df = order_cohort(spark, sf)
    return P.median_binarize(df, _fit(df), "price").select("record_key", "price_bin")


def _edges(col: str, bins: int) -> str:
    qs = ", ".join(str(i / bins) for i in range(1, bins))
    return f"e AS (SELECT quantile_cont({col}, [{qs}]) AS q, min({col}) AS lo, max({col}) AS hi FROM cohort WHERE {FIT})"


def _bins(col: str) -> str:
    return f"CASE WHEN {col} IS NOT NULL THEN len(list_filter(list_distinct(list_filter(q, lambda v: v > lo AND v < hi)), lambda v: v < {col})) END"


@query(f"WITH {COHORT}, {_edges('price', 4)} SELECT record_key, {_bins('price')} AS price_bin FROM cohort, e")
def quantile_binarize(spark, sf):
    df = order_cohort(spark, sf)
    return P.qcut(df, _fit(df), "price", 4).select("record_key", "price_bin")


@query(f"WITH {COHORT}, {_edges('avg_disc', 10)} SELECT record_key, {_bins('avg_disc')} AS avg_disc_bin FROM cohort, e")
def qcut_bins(spark, sf):
    df = order_cohort(spark, sf)
    return P.qcut(df, _fit(df), "avg_disc", 10).select("record_key", "avg_disc_bin")


_LEVELS = "lv AS (SELECT level, row_number() OVER (ORDER BY level) - 1 AS code FROM (SELECT DISTINCT seg AS level FROM cohort WHERE survey_year <= 1997 AND seg <> 'BUILDING'))"


@query(f"WITH {COHORT}, {_LEVELS} SELECT record_key, coalesce(code, (SELECT count(*) FROM lv)) AS seg_code FROM cohort LEFT JOIN lv ON seg = level")
def label_encode(spark, sf):
    df = order_cohort(spark, sf)
    return P.label_encode(df, _fit(df).filter("seg <> 'BUILDING'"), "seg").select("record_key", "seg_code")


@query(f"WITH {COHORT}, {_LEVELS} SELECT record_key, level AS seg_level FROM cohort LEFT JOIN lv ON seg = level")
def label_decode(spark, sf):
    """Codes of the fitted levels and back: a level that was not fitted has none."""
    df = order_cohort(spark, sf)
    fit = _fit(df).filter("seg <> 'BUILDING'")
    coded = P.label_encode(df, fit, "seg").select("record_key", "seg_code")
    return P.label_decode(coded, fit, "seg", "seg_code").select("record_key", "seg_level")


@query(f"WITH {COHORT}, {_LEVELS} SELECT record_key, coalesce(code, (SELECT count(*) FROM lv)) AS seg_code, round(coalesce(avg_disc, 0), 6) AS avg_disc_num FROM cohort LEFT JOIN lv ON seg = level")
def partition_encode(spark, sf):
    df = order_cohort(spark, sf)
    return rounded(P.partition_encode(df, _fit(df).filter("seg <> 'BUILDING'"), ["seg"], ["avg_disc"]).select("record_key", "seg_code", "avg_disc_num"))


@query(
    f"""WITH {COHORT} SELECT record_key, round(coalesce(CASE WHEN avg_disc BETWEEN 0.02 AND 0.08 THEN avg_disc END,
 (SELECT quantile_cont(avg_disc, 0.5) FROM cohort WHERE {FIT} AND avg_disc BETWEEN 0.02 AND 0.08)), 6) AS avg_disc_imp FROM cohort"""
)
def median_impute(spark, sf):
    df = order_cohort(spark, sf)
    return rounded(P.median_impute(df, _fit(df), "avg_disc", 0.02, 0.08).select("record_key", "avg_disc_imp"))


@query(f"WITH {CODED} SELECT id, CASE WHEN code IN (1, 2, 3) THEN code ELSE -1 END AS c FROM coded")
def categorical_sentinel(spark, sf):
    return coded_lines(spark, sf).select("id", P.sentinel(F.col("code"), [1, 2, 3]).alias("c"))


@query(f"WITH {COHORT} SELECT count(*) AS n FROM cohort WHERE {FIT}")
def fit_guard(spark, sf):
    return P.fit_guard(_fit(order_cohort(spark, sf)), "survey_year", [1995, 1996, 1997]).agg(F.count("*").alias("n"))


@query(f"WITH {COHORT}, s AS (SELECT min(price) AS lo, max(price) AS hi FROM cohort WHERE {FIT}) SELECT record_key, round((price - lo) / (hi - lo), 6) AS price_mm FROM cohort, s")
def minmax_scale(spark, sf):
    df = order_cohort(spark, sf)
    return rounded(P.minmax_scale(df, _fit(df), ["price"]).select("record_key", "price_mm"))


@query(f"WITH {COHORT}, s AS (SELECT avg(acctbal) AS m, stddev_pop(acctbal) AS sd FROM cohort WHERE {FIT}) SELECT record_key, round((acctbal - m) / sd, 6) AS acctbal_z FROM cohort, s")
def zscore_scale(spark, sf):
    df = order_cohort(spark, sf)
    return rounded(P.zscore_scale(df, _fit(df), ["acctbal"]).select("record_key", "acctbal_z"))


@query(
    f"""WITH {COHORT}, r AS (SELECT record_key, survey_year, 'seg' AS feature, CASE WHEN prio <> '5-LOW' THEN seg END AS raw FROM cohort),
v AS (SELECT feature, raw AS level, 0 AS k FROM r WHERE survey_year <= 1997 AND raw IS NOT NULL AND raw <> 'MACHINERY' GROUP BY 1, 2 UNION ALL VALUES ('seg', 'MISSING', 1), ('seg', 'UNKNOWN', 2)),
p AS (SELECT feature, level, row_number() OVER (ORDER BY k, level) - 1 AS pos FROM v)
SELECT record_key, r.feature, p.level, p.pos FROM r JOIN p ON p.level = CASE WHEN raw IS NULL THEN 'MISSING' WHEN raw = 'MACHINERY' THEN 'UNKNOWN' ELSE raw END"""
)
def vocab_onehot(spark, sf):
    df = order_cohort(spark, sf).withColumn("seg", F.when(F.col("prio") != "5-LOW", F.col("seg")))
    return P.vocab_onehot(df, _fit(df).filter("seg <> 'MACHINERY'"), "record_key", ["seg"])


_NMI = """ct AS ({cells}), t AS (SELECT feature, sum(n) AS t FROM ct GROUP BY feature),
hx AS (SELECT feature, -sum(p * ln(p)) AS h FROM (SELECT feature, sum(n) / any_value(t) AS p FROM ct JOIN t USING (feature) GROUP BY feature, category) GROUP BY feature),
hy AS (SELECT feature, -sum(p * ln(p)) AS h FROM (SELECT feature, sum(n) / any_value(t) AS p FROM ct JOIN t USING (feature) GROUP BY feature, y) GROUP BY feature),
hj AS (SELECT feature, -sum(p * ln(p)) AS h FROM (SELECT feature, n / t AS p FROM ct JOIN t USING (feature)) GROUP BY feature),
nmi AS (SELECT feature, greatest((hx.h + hy.h - hj.h) / ((hx.h + hy.h) / 2), 1e-6) AS nmi FROM hx JOIN hy USING (feature) JOIN hj USING (feature))"""
_CELLS2 = " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS category, y, count(*) AS n FROM cohort GROUP BY 2, 3" for f in ("seg", "prio"))


def feature_cells(df, features):
    return unpivot(df, features, "feature", "category", ["y"]).groupBy("feature", "category", "y").agg(F.count("*").alias("n"))


@query(f"WITH {COHORT}, {_NMI.format(cells=_CELLS2)} SELECT feature, round(nmi, 6) AS nmi FROM nmi")
def nmi(spark, sf):
    return rounded(P.nmi(feature_cells(order_cohort(spark, sf), ["seg", "prio"]), ["feature"]))


@query(f"WITH {COHORT}, {_NMI.format(cells=_CELLS2)} SELECT feature, round(nmi, 6) AS nmi, row_number() OVER (ORDER BY nmi DESC, feature) AS rank FROM nmi")
def importance(spark, sf):
    from pyspark.sql import Window

    out = P.nmi(feature_cells(order_cohort(spark, sf), ["seg", "prio"]), ["feature"])
    return rounded(out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("nmi"), "feature"))))  # a row per feature


@query(
    f"""WITH {COHORT}, {_NMI.format(cells=_CELLS2)},
{_NMI.replace("ct", "c2").replace("t AS (SELECT feature, sum(n) AS t", "t2 AS (SELECT feature, sum(n) AS t").replace("JOIN t USING", "JOIN t2 USING").replace("hx", "hx2").replace("hy", "hy2").replace("hj", "hj2").replace("nmi AS (", "nmi2 AS (").format(cells="SELECT 'prio' AS feature, CASE WHEN prio = '5-LOW' THEN '1-URGENT' ELSE prio END AS category, y, count(*) AS n FROM cohort GROUP BY 2, 3")}
SELECT a.feature, round(a.nmi, 6) AS nmi_before, round(b.nmi, 6) AS nmi_after, (a.nmi - b.nmi) / a.nmi <= 0.5 AS accepted FROM nmi a JOIN nmi2 b USING (feature)"""
)
def info_loss_gate(spark, sf):
    from ..operators.search import info_loss_gate as gate

    cell = feature_cells(order_cohort(spark, sf), ["prio"])
    merged = cell.withColumn("category", F.when(F.col("category") == "5-LOW", "1-URGENT").otherwise(F.col("category")))
    return rounded(gate(P.nmi(cell, ["feature"]), P.nmi(merged, ["feature"]), 0.5))


@query(f"WITH {COHORT} SELECT record_key, round(sign(acctbal) * pow(abs(acctbal), 1 / CAST(3 AS DOUBLE)), 6) AS x FROM cohort")
def power_transform(spark, sf):
    return rounded(order_cohort(spark, sf).select("record_key", X.power(F.col("acctbal"), 1 / 3).alias("x")))


@query(f"WITH {COHORT} SELECT record_key, round(abs(ln(abs(acctbal) + 1e-5) / ln(10)) * sign(acctbal), 6) AS x FROM cohort")
def log_transform(spark, sf):
    return rounded(order_cohort(spark, sf).select("record_key", X.log_transform(F.col("acctbal"), 10).alias("x")))


@query(
    f"""WITH {COHORT}, s AS (SELECT min(acctbal) AS lo, max(acctbal) AS hi FROM cohort), a AS (SELECT record_key, asin(least(greatest(2 * (acctbal - lo) / (hi - lo) - 1, -1), 1)) AS v FROM cohort, s)
SELECT record_key, round(sign(v) * pow(abs(v), 3), 6) AS x FROM a"""
)
def arcsin_transform(spark, sf):
    df = order_cohort(spark, sf)
    s = df.agg(F.min("acctbal").alias("lo"), F.max("acctbal").alias("hi"))
    out = df.select("record_key", "acctbal").crossJoin(F.broadcast(s))  # one row
    return rounded(out.select("record_key", X.arcsin_transform(F.col("acctbal"), F.col("lo"), F.col("hi"), 3).alias("x")))


@query(f"WITH {COHORT} SELECT record_key, round(pow(p1, 3), 6) AS t1, round(pow(p1, 3) * pow(p1, 5), 6) AS t2, round(pow(p1, 3) + pow(p1, 5) + pow(p1, 7), 6) AS t3 FROM cohort")
def multi_beta(spark, sf):
    s, x = X.exponent_stream("d4A"), F.col("p1")
    return rounded(order_cohort(spark, sf).select("record_key", X.multi_beta(x, s, 1, "t1").alias("t1"), X.multi_beta(x, s, 2, "t2").alias("t2"), X.multi_beta(x, s, 3, "t3").alias("t3")))


@query(f"WITH {COHORT} SELECT record_key, round(CAST(0.3 AS DOUBLE) * p1 + CAST(0.7 AS DOUBLE) * p2, 6) AS x FROM cohort")
def beta_mix(spark, sf):
    return rounded(order_cohort(spark, sf).select("record_key", X.beta_mix(F.col("p1"), F.col("p2"), 0.3).alias("x")))


@query(
    """SELECT r_name AS source, mode, i AS pos, round(v, 6) AS p FROM region, (SELECT 'd4A' AS mode, i, CAST(2 * i + 3 AS DOUBLE) AS v FROM range(10) r(i) UNION ALL SELECT 'd4B', i, 1 / (2 * i + 3) FROM range(10) r(i)
 UNION ALL SELECT 'official', i, CASE WHEN i % 2 = 0 THEN CAST(i + 3 AS DOUBLE) ELSE 1 / (i + 2) END FROM range(1998) r(i))"""
)
def exponent_streams(spark, sf):
    streams = [F.struct(F.lit(m).alias("mode"), X.exponent_stream(m).alias("s")) for m in ("d4A", "d4B", "official")]
    df = table(spark, sf, "region").select(F.col("r_name").alias("source"), F.inline(F.array(*streams)))
    return rounded(df.select("source", "mode", F.posexplode("s").alias("pos", "p")))


@query(
    f"""WITH {COHORT}, m AS (SELECT seg, max(abs(price)) AS m FROM cohort GROUP BY seg) SELECT seg, CAST(p AS INT) AS p, p * ln(m) > ln(3.4028234663852886e38) AS overflow FROM m, (VALUES (3), (5), (7), (9), (11)) t(p)"""
)
def overflow_rule(spark, sf):
    m = order_cohort(spark, sf).groupBy("seg").agg(F.max(F.abs("price")).alias("m"))
    return m.select("seg", "m", F.explode(F.array(*[F.lit(p) for p in (3, 5, 7, 9, 11)])).alias("p")).select("seg", "p", X.overflows(F.col("m"), F.col("p")).alias("overflow"))


_MERGE = {"1-URGENT": "2-HIGH", "5-LOW": "3-MEDIUM"}
_MERGED = "CASE WHEN prio = '1-URGENT' THEN '2-HIGH' WHEN prio = '5-LOW' THEN '3-MEDIUM' ELSE prio END"


@query(f"WITH {COHORT} SELECT record_key, {_MERGED} AS prio FROM cohort")
def category_merge(spark, sf):
    m = F.create_map(*[F.lit(x) for kv in _MERGE.items() for x in kv])
    return order_cohort(spark, sf).select("record_key", X.merge_categories(F.col("prio"), m).alias("prio"))


@query("""SELECT r_regionkey, 'a' AS k, 'c' AS v FROM region UNION ALL SELECT r_regionkey, 'b', 'c' FROM region UNION ALL SELECT r_regionkey, 'x', CAST(r_regionkey AS VARCHAR) FROM region""")
def compose_mapping(spark, sf):
    region = table(spark, sf, "region")
    old = F.create_map(F.lit("a"), F.lit("b"), F.lit("x"), F.col("r_regionkey").cast("string"))
    new = F.create_map(F.lit("b"), F.lit("c"))
    return region.select("r_regionkey", F.explode(X.compose_mapping(old, new)).alias("k", "v"))


_STATE = {"price": {"power": 3}, "prio": {"merge": _MERGE}, "acctbal": "dropped"}


@query(f"WITH {COHORT} SELECT record_key, seg, prio FROM cohort")
def drop_feature(spark, sf):
    df = order_cohort(spark, sf).select("record_key", "seg", "prio", "acctbal")
    return X.apply_state(df, {"acctbal": "dropped"})


@query(f"WITH {COHORT} SELECT record_key, {_MERGED} AS prio, round(pow(p1, 3), 6) AS p1 FROM cohort")
def apply_state(spark, sf):
    df = order_cohort(spark, sf).select("record_key", "prio", "p1", "acctbal")
    return rounded(X.apply_state(df, {"p1": {"power": 3}, "prio": {"merge": _MERGE}, "acctbal": "dropped"}))


def _validity(col: str) -> str:
    n_null, n_inf, n_distinct = f"count(*) FILTER ({col} IS NULL)", f"count(*) FILTER (isinf(CAST({col} AS DOUBLE)))", f"count(DISTINCT {col})"
    status = f"CASE WHEN {n_null} > 0 THEN 'NULLS' WHEN {n_inf} > 0 THEN 'INFINITE' WHEN {n_distinct} < 2 THEN 'COLLAPSED' ELSE 'VALID' END"
    return f"SELECT '{col}' AS feature, {n_null} AS n_null, {n_inf} AS n_inf, {n_distinct} AS n_distinct, {status} AS status FROM features"


@query(f"WITH {COHORT}, features AS (SELECT *, 1 AS one FROM cohort) " + " UNION ALL ".join(map(_validity, ["avg_disc", "price", "one"])))
def validity_check(spark, sf):
    return X.validity_check(order_cohort(spark, sf).withColumn("one", F.lit(1)), ["avg_disc", "price", "one"])


_R1 = """s AS (SELECT seg AS grp, prio AS category, count(*) / sum(count(*)) OVER (PARTITION BY seg) AS p FROM cohort GROUP BY 1, 2),
g AS (SELECT DISTINCT grp FROM s), q AS (SELECT a.grp AS grp_a, b.grp AS grp_b FROM g a JOIN g b ON a.grp < b.grp), c AS (SELECT DISTINCT category FROM s),
d AS (SELECT grp_a, grp_b, c.category, round(coalesce(y.p, 0) - coalesce(x.p, 0), 12) AS diff FROM q CROSS JOIN c LEFT JOIN s x ON x.grp = grp_a AND x.category = c.category LEFT JOIN s y ON y.grp = grp_b AND y.category = c.category),
r AS (SELECT *, row_number() OVER (PARTITION BY grp_a, grp_b ORDER BY diff DESC, category) AS hi, row_number() OVER (PARTITION BY grp_a, grp_b ORDER BY diff, category DESC) AS lo FROM d)"""


@query(
    f"""WITH {COHORT}, {_R1} SELECT 'seg' AS attr, 'prio' AS feature, a.grp_a, a.grp_b, a.hi AS rank, a.category AS src, b.category AS dst, round(abs(a.diff - b.diff), 6) AS gap
 FROM r a JOIN r b ON a.grp_a = b.grp_a AND a.grp_b = b.grp_b AND a.hi = b.lo WHERE a.category <> b.category AND a.hi <= 5"""
)
def rebin_r1(spark, sf):
    return rounded(X.rebin_r1(G.cells(order_cohort(spark, sf), ["seg"], ["prio"])))


def _prio_counts(spark, sf):
    return order_cohort(spark, sf).groupBy("seg", F.col("prio").alias("category"), "y").agg(F.count("*").alias("n"))


@query(
    f"""WITH {COHORT}, r AS (SELECT seg, prio AS category, row_number() OVER (PARTITION BY seg ORDER BY count(*), prio) AS r FROM cohort GROUP BY 1, 2)
SELECT a.seg, a.category AS src, b.category AS dst FROM r a JOIN r b ON a.seg = b.seg AND a.r = 2 AND b.r = 1"""
)
def rebin_r2(spark, sf):
    counts = _prio_counts(spark, sf).groupBy("seg", "category").agg(F.sum("n").alias("n"))
    return X.rebin_r2(counts, ["seg"])


@query(
    f"""WITH {COHORT}, g AS (SELECT seg, prio AS category, sum(CASE WHEN y = 1 THEN 1 ELSE -1 END) AS g FROM cohort GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY g DESC, category DESC) AS hi, row_number() OVER (PARTITION BY seg ORDER BY g, category) AS lo FROM g)
SELECT a.seg, a.category AS src, b.category AS dst, a.g - b.g AS gap FROM r a JOIN r b ON a.seg = b.seg AND a.hi = 1 AND b.lo = 1"""
)
def rebin_target_r1(spark, sf):
    return X.rebin_target_r1(_prio_counts(spark, sf), ["seg"])


@query(
    f"""WITH {COHORT}, g AS (SELECT seg, prio AS category, round(sum(y) / count(*), 12) AS r FROM cohort GROUP BY 1, 2),
l AS (SELECT seg, lag(category) OVER w AS low, category AS high, round(r - lag(r) OVER w, 12) AS diff FROM g WINDOW w AS (PARTITION BY seg ORDER BY r, category))
SELECT seg, low, high, round(diff, 6) AS diff, row_number() OVER (PARTITION BY seg ORDER BY diff, low) AS rank FROM l WHERE low IS NOT NULL"""
)
def rebin_target_adjacent(spark, sf):
    return rounded(X.rebin_target_adjacent(_prio_counts(spark, sf), ["seg"]))


@query(
    f"""WITH {COHORT}, t AS (SELECT seg, price, pow(p1 - CAST(0.5 AS DOUBLE), 2) * price AS z FROM cohort),
r AS (SELECT rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2 AS ra, rank() OVER (ORDER BY z) + (count(*) OVER (PARTITION BY z) - 1) / 2 AS rb FROM t),
m AS (SELECT avg(price) AS mb, avg(z) AS ma FROM t GROUP BY seg)
SELECT round((SELECT corr(ra, rb) FROM r), 6) AS spearman, round(max(mb) - min(mb), 6) AS gap_before, round(max(ma) - min(ma), 6) AS gap_after FROM m"""
)
def transform_audit(spark, sf):
    df = order_cohort(spark, sf).withColumn("z", F.pow(F.col("p1") - 0.5, 2) * F.col("price"))
    return rounded(X.transform_audit(df, "record_key", "price", "z", "seg"))


@query(
    """SELECT p_brand AS feature, CASE WHEN p_brand = 'Brand#11' THEN false ELSE true END AS equal FROM (SELECT DISTINCT p_brand FROM part)"""
)
def state_equivalence(spark, sf):
    a = table(spark, sf, "part").select(F.col("p_brand").alias("feature")).distinct().withColumns({"kind": F.lit("power"), "power": F.lit(3.0)})
    b = a.withColumn("power", F.when(F.col("feature") == "Brand#11", 3.1).otherwise(3.0 + 1e-9))
    return X.state_equivalence(a, b)


_TRACE = [("prio", "merge", {"1-URGENT": "2-HIGH"}), ("p1", "power", 3), ("prio", "merge", {"2-HIGH": "3-MEDIUM"}), ("p1", "power", 5), ("acctbal", "drop", None)]


@query(
    f"""WITH {COHORT} """
    + " UNION ALL ".join(
        f"SELECT {i} AS state_id, {p} AS prio, round(sum({x}), 6) AS p1, {a} AS has_acctbal, count(*) AS n FROM cohort GROUP BY 2"
        for i, (p, x, a) in enumerate(
            [
                ("prio", "p1", "true"),
                ("CASE WHEN prio = '1-URGENT' THEN '2-HIGH' ELSE prio END", "p1", "true"),
                ("CASE WHEN prio = '1-URGENT' THEN '2-HIGH' ELSE prio END", "pow(p1, 3)", "true"),
                ("CASE WHEN prio IN ('1-URGENT', '2-HIGH') THEN '3-MEDIUM' ELSE prio END", "pow(p1, 3)", "true"),
                ("CASE WHEN prio IN ('1-URGENT', '2-HIGH') THEN '3-MEDIUM' ELSE prio END", "pow(p1, 5)", "true"),
                ("CASE WHEN prio IN ('1-URGENT', '2-HIGH') THEN '3-MEDIUM' ELSE prio END", "pow(p1, 5)", "false"),
            ]
        )
    )
)
def replay_trace(spark, sf):
    df = order_cohort(spark, sf).select("prio", "p1", "acctbal")
    out = None
    for i, state in enumerate(X.replay_states(_TRACE)):
        one = X.apply_state(df, state)
        row = one.groupBy("prio").agg(F.sum("p1").alias("p1"), F.count("*").alias("n"))
        row = row.select(F.lit(i).alias("state_id"), "prio", "p1", F.lit("acctbal" in one.columns).alias("has_acctbal"), "n")
        out = row if out is None else out.unionByName(row)
    return rounded(out)


@query("SELECT CAST(0 AS BIGINT) AS only_replayed, CAST(0 AS BIGINT) AS only_direct, 'PASS' AS status")
def replay_verify(spark, sf):
    df = order_cohort(spark, sf).select("record_key", "prio", "p1", "acctbal")
    a = X.apply_state(df, X.replay_states(_TRACE)[-1])
    both = F.create_map(F.lit("1-URGENT"), F.lit("3-MEDIUM"), F.lit("2-HIGH"), F.lit("3-MEDIUM"))
    b = df.select("record_key", X.merge_categories(F.col("prio"), both).alias("prio"), X.power(F.col("p1"), 5).alias("p1"))
    one = a.exceptAll(b).agg(F.count("*").alias("only_replayed")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("only_direct")))  # one row each
    return one.withColumn("status", F.when((F.col("only_replayed") == 0) & (F.col("only_direct") == 0), "PASS").otherwise("FAIL"))


@query(
    f"""WITH {CODED}, m AS (SELECT DISTINCT route AS feature, CASE WHEN code = 7 THEN -1 ELSE code END AS code, CASE WHEN code IN (1, 3) THEN 1 WHEN code IN (2, 7) THEN 2 ELSE 3 END AS target FROM coded),
t AS (SELECT feature, count(DISTINCT target) AS k FROM m GROUP BY 1)
SELECT feature, target, count(*) AS codes, (count(*) FILTER (code < 0) > 0 AND count(*) FILTER (code >= 0) > 0) AS missing_pooled, max(code) - min(code) + 1 <> count(*) AS non_contiguous, any_value(k) = 1 AS all_collapsed
FROM m JOIN t USING (feature) GROUP BY feature, target"""
)
def merge_review_flags(spark, sf):
    code = F.col("code")
    m = coded_lines(spark, sf).select(
        F.col("route").alias("feature"), F.when(code == 7, -1).otherwise(code).alias("code"),
        F.when(code.isin(1, 3), 1).when(code.isin(2, 7), 2).otherwise(3).alias("target"),
    ).distinct()
    return X.merge_review_flags(m)


