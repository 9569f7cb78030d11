"""Sources, contracts, recodes, splits and joins on the coded frame and the cohort."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cohort import coded_lines, order_cohort, table
from ..functions.columns import rounded, unpivot
from ..operators import contracts as C
from ..operators import metrics as M
from ..operators import recode as K
from ..operators import splits as S
from ..sources.tabular import load, load_declared_csv, scratch, write_parquet_guarded, write_report
from .registry import CODED, COHORT, EXPECTED_SQL, LONG, query

REGISTRY = [("code", "outcome", "integer"), ("route", "predictor", "string"), ("prot", "protected", "string"), ("w", "weight", "float"), ("absent", "predictor", "integer"), ("orderkey", "key", "integer")]


@query("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderpriority")
def scan_tabular(spark, sf):
    return load(spark, f"{sf}/orders.parquet").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def scan_declared_csv(spark, sf):
    path = scratch(spark, "csv")
    table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity").write.option("header", True).csv(path)
    schema = T.StructType([T.StructField("l_orderkey", T.LongType()), T.StructField("l_linenumber", T.IntegerType()), T.StructField("l_quantity", T.DoubleType())])
    return load_declared_csv(spark, path, schema)


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def sink_parquet_guarded(spark, sf):
    path = scratch(spark, "guarded")
    df = table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    if not write_parquet_guarded(df, path) or write_parquet_guarded(df, path):
        raise AssertionError("the first write writes, the second finds equal content")
    return spark.read.parquet(path)


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def sink_report(spark, sf):
    path = scratch(spark, "report")
    write_report(table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n")), path)
    return spark.read.schema("c_mktsegment string, n long").option("header", True).csv(path)


@query(
    f"WITH {CODED} "
    + " UNION ALL ".join(
        f"SELECT '{v}' AS variable, '{r}' AS role, '{t}' AS declared_type, {'false' if v == 'absent' else 'true'} AS present, "
        + ("CAST(NULL AS BIGINT) AS n_value, CAST(NULL AS BIGINT) AS n_nonnumeric, 'FAIL' AS status" if v == "absent" else
           f"count({v}) AS n_value, count(*) FILTER ({v} IS NOT NULL AND TRY_CAST(CAST({v} AS VARCHAR) AS DOUBLE) IS NULL) AS n_nonnumeric, 'PASS' AS status FROM coded")
        for v, r, t in REGISTRY
    )
)
def schema_audit(spark, sf):
    return C.schema_audit(coded_lines(spark, sf), REGISTRY)


_DOMAIN = [("code", str(c)) for c in range(1, 7)] + [("route", "A"), ("route", "N"), ("route", "R"), ("prot", "F")]
_DOMAIN_SQL = "dom AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _DOMAIN) + ") t(variable, code))"
_LONGCODE = "lc AS (SELECT 'code' AS variable, CAST(code AS VARCHAR) AS code FROM coded UNION ALL SELECT 'route', route FROM coded UNION ALL SELECT 'prot', prot FROM coded)"


@query(
    f"""WITH {CODED}, {_DOMAIN_SQL}, {_LONGCODE}, v AS (SELECT variable, count(*) FILTER (code IS NOT NULL AND NOT EXISTS (SELECT 1 FROM dom WHERE dom.variable = lc.variable AND dom.code = lc.code)) AS n_outside,
 count(*) FILTER (code IS NULL) AS n_null FROM lc GROUP BY variable)
SELECT variable, n_outside, n_null, CASE WHEN n_outside > 0 OR (n_null > 0 AND variable <> 'prot') THEN 'FAIL' ELSE 'PASS' END AS status FROM v"""
)
def code_domain_check(spark, sf):
    return C.code_domain_check(coded_lines(spark, sf), spark.createDataFrame(_DOMAIN, "variable string, code string"), ["prot"])


_FREQ = [(1, 15000), (2, 12000), (9, 5)]


@query(
    f"""WITH {CODED}, o AS (SELECT code, count(*) AS observed FROM coded GROUP BY code), e AS (SELECT * FROM (VALUES (1, 15000), (2, 12000), (9, 5)) t(code, expected))
SELECT coalesce(o.code, e.code) AS code, coalesce(observed, 0) AS observed, coalesce(expected, 0) AS expected, coalesce(observed, 0) = coalesce(expected, 0) AS matches FROM o FULL JOIN e ON o.code = e.code"""
)
def frequency_contract(spark, sf):
    return C.frequency_contract(coded_lines(spark, sf), "code", spark.createDataFrame(_FREQ, "code int, expected long"))


@query(
    f"""WITH {CODED}, y AS (SELECT survey_year, count(*) AS n, count(*) FILTER (code IS NULL OR code NOT BETWEEN 1 AND 7) AS bad, count(DISTINCT code) AS codes FROM coded GROUP BY survey_year)
SELECT survey_year, 'row_count' AS check_name, CASE WHEN n >= 1000 THEN 'PASS' ELSE 'FAIL' END AS status FROM y
UNION ALL SELECT survey_year, 'all_codes', CASE WHEN codes = 7 THEN 'PASS' ELSE 'FAIL' END FROM y
UNION ALL SELECT survey_year, 'code_domain', CASE WHEN bad > 0 THEN 'FAIL' ELSE 'PASS' END FROM y"""
)
def source_validate(spark, sf):
    aggs = [F.count("*").alias("n"), F.count_if(F.col("code").isNull() | ~F.col("code").between(1, 7)).alias("bad"), F.count_distinct("code").alias("codes")]
    checks = {"row_count": F.col("n") >= 1000, "all_codes": F.col("codes") == 7, "code_domain": F.col("bad") == 0}
    each = F.array(*[F.struct(F.lit(k).alias("check_name"), F.when(v, "PASS").otherwise("FAIL").alias("status")) for k, v in checks.items()])
    return coded_lines(spark, sf).groupBy("survey_year").agg(*aggs).select("survey_year", F.inline(each))


_ROLED = """roled AS (SELECT survey_year, CASE WHEN survey_year <= 1997 THEN 'fit' WHEN survey_year = 1998 THEN 'calibration' WHEN survey_year = 1999 THEN 'selection' ELSE 'test' END AS role,
 w, CASE WHEN survey_year < 2001 THEN w / 2 END AS w_dev FROM cohort)"""


@query(
    f"""WITH {COHORT}, {_ROLED} SELECT survey_year, string_agg(DISTINCT role, ',') AS roles, count(DISTINCT role) AS n_roles,
 count(*) FILTER (CASE WHEN survey_year = 2001 THEN w_dev IS NOT NULL ELSE w_dev IS NULL OR abs(w_dev - w / 2) >= 1e-9 END) AS bad_dev, 'PASS' AS status FROM roled GROUP BY survey_year"""
)
def role_contract(spark, sf):
    year = F.col("survey_year")
    role = F.when(year <= 1997, "fit").when(year == 1998, "calibration").when(year == 1999, "selection").otherwise("test")
    df = order_cohort(spark, sf).withColumn("role", role).withColumn("w_dev", F.when(year < 2001, F.col("w") / 2))
    return C.role_contract(df, "survey_year", "role", "w", "w_dev", 2001)


@query("SELECT * FROM (VALUES ('y', 1, 'PASS'), ('w', 1, 'PASS'), ('psu', 1, 'PASS'), ('gone', 0, 'FAIL')) t(\"column\", times, status)")
def harmonized_columns_check(spark, sf):
    return C.columns_check(order_cohort(spark, sf), ["y", "w", "psu", "gone"])


@query(
    f"""WITH {COHORT}, k AS (SELECT length(CAST(survey_year AS VARCHAR)) || ':' || survey_year || length(CAST(record_key AS VARCHAR)) || ':' || record_key AS k FROM cohort)
SELECT count(*) AS n, CAST(sum(CAST('0x' || substr(sha256(k), 1, 15) AS BIGINT)) AS VARCHAR) AS digest FROM k"""
)
def cohort_digest(spark, sf):
    return C.cohort_digest(order_cohort(spark, sf), ["survey_year", "record_key"])


@query(f"WITH {CODED} SELECT id, CASE WHEN w / 2 = round(w / 2) THEN CAST(w / 2 AS BIGINT) END AS half FROM coded")
def canonical_code(spark, sf):
    return coded_lines(spark, sf).select("id", K.canonical_code(F.col("w") / 2).alias("half"))


_BIN = "CASE WHEN code = 1 THEN 1 WHEN code = 2 THEN 0 END"


@query(f"WITH {CODED} SELECT id, {_BIN} AS y FROM coded")
def recode_binary(spark, sf):
    return coded_lines(spark, sf).select("id", K.recode_binary(F.col("code"), [3, 4, 5, 6, 7]).alias("y"))


@query(f"WITH {CODED} SELECT id, CASE WHEN code <= 6 THEN code END AS c FROM coded")
def recode_categorical(spark, sf):
    return coded_lines(spark, sf).select("id", K.recode_categorical(F.col("code"), [1, 2, 3, 4, 5, 6], [7]).alias("c"))


@query(f"WITH {CODED} SELECT id, CASE WHEN code <= 5 THEN code END AS c FROM coded")
def recode_predictor(spark, sf):
    return coded_lines(spark, sf).select("id", K.recode_predictor(F.col("code"), {"valid_codes": [1, 2, 3, 4, 5], "missing_codes": [6, 7]}).alias("c"))


@query(f"WITH {CODED} SELECT survey_year, count(w) AS n, round(sum(w), 6) AS total FROM coded GROUP BY survey_year")
def parse_weight(spark, sf):
    df = coded_lines(spark, sf).withColumn("x", K.parse_weight(F.col("w").cast("string")))
    return rounded(df.groupBy("survey_year").agg(F.count("x").alias("n"), F.sum("x").alias("total")))


@query(f"WITH {CODED} SELECT id, CASE WHEN survey_year IN (1996, 1997) THEN w / 2 END AS w_dev FROM coded")
def dev_weight(spark, sf):
    return coded_lines(spark, sf).select("id", K.dev_weight(F.col("w"), F.col("survey_year"), [1996, 1997]).alias("w_dev"))


@query(f"WITH {CODED} SELECT id, CASE WHEN route NOT IN ('A', 'R') THEN -1 WHEN code = 1 THEN 1 WHEN code = 2 THEN 2 ELSE -2 END AS state FROM coded")
def employment_state(spark, sf):
    return coded_lines(spark, sf).select("id", K.routed_state(F.col("route"), ["A", "R"], F.col("code"), 1, 2).alias("state"))


@query(f"WITH {CODED} SELECT id, CASE WHEN code = 1 THEN '1' WHEN code = 2 THEN '0' ELSE 'missing_or_non_substantive' END AS state FROM coded")
def outcome_state(spark, sf):
    df = coded_lines(spark, sf)
    return df.select("id", K.outcome_state(K.recode_binary(F.col("code"), [3, 4, 5, 6, 7])).alias("state"))


def _harmonized(year: int) -> str:
    return f"""SELECT 'lines:' || survey_year || ':' || id AS record_key, survey_year, 'fit' AS role, code AS code_raw, {_BIN} AS y, prot, w,
 CASE WHEN survey_year IN (1996) THEN w / 2 END AS w_dev FROM coded WHERE survey_year = {year}"""


def _year(spark, sf, year):
    return K.harmonize_year(coded_lines(spark, sf), year, "fit", [1996], [9])


@query(f"WITH {CODED} {_harmonized(1996)}")
def harmonize_year(spark, sf):
    return _year(spark, sf, 1996)


@query(f"WITH {CODED} {_harmonized(1996)} UNION ALL {_harmonized(1997)}")
def union_years(spark, sf):
    return K.union_years({y: _year(spark, sf, y) for y in (1996, 1997, 1998)}, [1996, 1997])


@query(f"WITH {CODED}, k AS (SELECT 'orders:' || survey_year || ':' || orderkey AS record_key FROM coded) SELECT record_key, count(*) AS n FROM k GROUP BY record_key HAVING count(*) > 1")
def record_key(spark, sf):
    df = coded_lines(spark, sf).select(K.record_key(F.lit("orders"), F.col("survey_year"), F.col("orderkey")).alias("record_key"))
    return K.duplicate_keys(df, "record_key")


def _masked(spark, sf):
    df = order_cohort(spark, sf)
    return df.withColumn("y", F.when(F.col("prio") != "5-LOW", F.col("y"))).withColumn("seg", F.when(F.col("seg") != "BUILDING", F.col("seg")))


_MASKED = COHORT + ", masked AS (SELECT record_key, stratum, psu, p1, w, survey_year, CASE WHEN prio <> '5-LOW' THEN y END AS y, CASE WHEN seg <> 'BUILDING' THEN seg END AS seg FROM cohort)"


@query(f"WITH {_MASKED} SELECT record_key, y, seg FROM masked WHERE y IS NOT NULL AND seg IS NOT NULL")
def cohort_filter(spark, sf):
    return K.cohort_filter(_masked(spark, sf), "y", "seg").select("record_key", "y", "seg")


@query(f"WITH {_MASKED} SELECT record_key, (y IS NOT NULL AND seg IS NOT NULL AND p1 > 0.1) AS in_domain FROM masked")
def domain_mask(spark, sf):
    return K.domain_mask(_masked(spark, sf), "y", "seg", [F.col("p1") > 0.1]).select("record_key", "in_domain")


@query(f"WITH {_MASKED} SELECT record_key, stratum, psu, CAST(CASE WHEN y IS NOT NULL AND seg IS NOT NULL THEN p1 ELSE 0 END AS DOUBLE) AS p1 FROM masked")
def expand_domain(spark, sf):
    df = _masked(spark, sf)
    return K.expand_domain(df.select("record_key", "stratum", "psu"), K.cohort_filter(df, "y", "seg"), "record_key", ["p1"])


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def positive_weight_filter(spark, sf):
    return table(spark, sf, "customer").filter(K.positive_weight(F.col("c_acctbal"))).select("c_custkey", "c_acctbal")


_U = "((record_key * 7919 + {seed} * 104729) % 1000003) / 1000003"


def _split_sql(strata: str, seed: int) -> str:
    return f"""split AS (SELECT *, CASE WHEN r <= round(n * 0.64) THEN 'train' WHEN r <= round(n * 0.64) + round(n * 0.16) THEN 'val' ELSE 'test' END AS split FROM (
 SELECT *, row_number() OVER (PARTITION BY {strata} ORDER BY {_U.format(seed=seed)}, record_key) AS r, count(*) OVER (PARTITION BY {strata}) AS n FROM cohort))"""


@query(f"WITH {COHORT}, {_split_sql('survey_year, y', 0)} SELECT record_key, split FROM split")
def stratified_split(spark, sf):
    return S.stratified_split(order_cohort(spark, sf), ["survey_year", "y"], "record_key").select("record_key", "split")


@query(
    f"""WITH {COHORT}, {_split_sql('survey_year, y', 0)}, c AS (SELECT survey_year, y, count(*) AS n, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val,
 count(*) FILTER (split = 'test') AS test FROM split GROUP BY survey_year, y), d AS (SELECT *, greatest(abs(train / n - 0.64), abs(val / n - 0.16), abs(test / n - 0.2)) AS worst FROM c)
SELECT survey_year, y, n, train, val, test, round(worst, 6) AS worst, CASE WHEN worst <= 0.02 THEN 'PASS' ELSE 'FAIL' END AS status FROM d"""
)
def split_audit(spark, sf):
    return rounded(S.split_audit(S.stratified_split(order_cohort(spark, sf), ["survey_year", "y"], "record_key"), ["survey_year", "y"]))


@query(f"WITH {COHORT}, {_split_sql('y', 3)} SELECT record_key, split FROM split")
def train_val_test_split(spark, sf):
    return S.stratified_split(order_cohort(spark, sf), ["y"], "record_key", seed=3).select("record_key", "split")


_CL = "cl AS (SELECT DISTINCT stratum, psu, CASE WHEN (((stratum * 1000 + psu) * 7919 + 104729) % 1000003) / 1000003 < 0.2 THEN 'calibration' ELSE 'fitting' END AS cluster_role FROM cohort)"


@query(f"WITH {COHORT}, {_CL} SELECT * FROM cl")
def psu_split(spark, sf):
    return S.cluster_roles(order_cohort(spark, sf), "stratum", "psu", 1)


@query(
    f"""WITH {COHORT}, {_CL} SELECT record_key, CASE WHEN survey_year IN (1995, 1996, 1997, 1998) THEN CASE WHEN cluster_role = 'calibration' THEN 'C' ELSE 'F' END
 WHEN survey_year = 1999 THEN 'S' WHEN survey_year > 1999 THEN 'T' END AS role FROM cohort JOIN cl USING (stratum, psu)"""
)
def role_partition(spark, sf):
    df = order_cohort(spark, sf)
    roles = S.cluster_roles(df, "stratum", "psu", 1)
    return S.role_partition(df, roles, "survey_year", "stratum", "psu", [1995, 1996, 1997, 1998], 1999).select("record_key", "role")


@query(f"WITH {COHORT}, {_CL} SELECT record_key, cluster_role FROM cohort JOIN cl USING (stratum, psu)")
def join_cluster_role(spark, sf):
    df = order_cohort(spark, sf)
    return df.join(S.cluster_roles(df, "stratum", "psu", 1), ["stratum", "psu"]).select("record_key", "cluster_role")


@query(f"WITH {COHORT} SELECT y, count(*) AS n FROM cohort WHERE ((record_key * 7919 + 7 * 104729) % 1000003) / 1000003 < 0.3 GROUP BY y")
def subsample_fit(spark, sf):
    return order_cohort(spark, sf).filter(S.hash_uniform(F.col("record_key"), 7) < 0.3).groupBy("y").agg(F.count("*").alias("n"))


@query(
    f"""WITH {COHORT} SELECT (SELECT count(*) FROM (SELECT DISTINCT record_key FROM cohort WHERE price < 200000) WHERE record_key IN (SELECT record_key FROM cohort WHERE price >= 150000)) AS shared,
 CAST(0 AS BIGINT) AS repeated_a, CAST(0 AS BIGINT) AS repeated_b, 'FAIL' AS status"""
)
def partition_disjoint(spark, sf):
    df = order_cohort(spark, sf)
    return S.partition_disjoint(df.filter("price < 200000"), df.filter("price >= 150000"), "record_key")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def semi_join_domain(spark, sf):
    domain = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").join(domain, "l_orderkey", "left_semi")


@query(f"WITH {LONG}, {EXPECTED_SQL} SELECT attr, grp FROM expected e WHERE NOT EXISTS (SELECT 1 FROM long WHERE long.attr = e.attr AND long.grp = e.grp)")
def anti_join_missing_groups(spark, sf):
    from .metric_queries import expected, groups

    return expected(spark).join(groups(spark, sf), ["attr", "grp"], "left_anti")


@query(
    f"""WITH {COHORT}, c AS (SELECT prio, count(*) FILTER (seg = 'BUILDING') AS a, count(*) FILTER (seg = 'MACHINERY') AS b FROM cohort WHERE (seg = 'BUILDING' AND prio < '4') OR (seg = 'MACHINERY' AND prio > '2') GROUP BY prio)
SELECT prio, a, b FROM c"""
)
def outer_align_categories(spark, sf):
    df = order_cohort(spark, sf)
    a = df.filter("seg = 'BUILDING' AND prio < '4'").groupBy("prio").agg(F.count("*").alias("a"))
    b = df.filter("seg = 'MACHINERY' AND prio > '2'").groupBy("prio").agg(F.count("*").alias("b"))
    return a.join(b, "prio", "full").select("prio", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("a", "b")])


@query(f"WITH {LONG}, g AS (SELECT DISTINCT attr, grp FROM long) SELECT a.attr, a.grp AS grp_a, b.grp AS grp_b FROM g a JOIN g b ON a.attr = b.attr AND a.grp < b.grp")
def theta_self_join_pairs(spark, sf):
    from .metric_queries import groups

    return M.pair_gaps(groups(spark, sf), ["attr"], ())


_YS = "y{i} AS (SELECT seg, avg(CAST(yhat AS DOUBLE)) AS sr, avg(CAST(CASE WHEN y = yhat THEN 1 ELSE 0 END AS DOUBLE)) AS acc FROM cohort WHERE survey_year = {i} GROUP BY seg)"


@query(f"WITH {COHORT}, {_YS.format(i=1999)}, {_YS.format(i=2000)} SELECT seg, round(a.sr, 6) AS val_sr, round(b.sr, 6) AS test_sr, round(b.acc - a.acc, 6) AS d_acc FROM y1999 a JOIN y2000 b USING (seg)")
def join_val_test(spark, sf):
    df = order_cohort(spark, sf)

    def part(year):
        hit = (F.col("y") == F.col("yhat")).cast("double")
        return df.filter(F.col("survey_year") == year).groupBy("seg").agg(F.avg(F.col("yhat").cast("double")).alias("sr"), F.avg(hit).alias("acc"))

    a, b = part(1999).alias("a"), part(2000).alias("b")
    return rounded(a.join(b, "seg").select("seg", F.col("a.sr").alias("val_sr"), F.col("b.sr").alias("test_sr"), (F.col("b.acc") - F.col("a.acc")).alias("d_acc")))


@query(f"WITH {LONG}, n AS (SELECT DISTINCT attr AS node FROM long UNION ALL SELECT 'origin') SELECT a.node AS node_a, b.node AS node_b FROM n a JOIN n b ON a.node < b.node")
def cross_join_nodes(spark, sf):
    from .metric_queries import groups

    nodes = groups(spark, sf).select(F.col("attr").alias("node")).distinct().union(spark.createDataFrame([("origin",)], "node string"))
    a, b = nodes.alias("a"), nodes.alias("b")
    return a.join(b, F.col("a.node") < F.col("b.node")).select(F.col("a.node").alias("node_a"), F.col("b.node").alias("node_b"))


def long_codes(spark, sf):
    return unpivot(coded_lines(spark, sf), ["code", "route", "prot"], "variable", "code_text", [])
