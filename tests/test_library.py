"""Hand numbers, metamorphic laws and cross-checks between two formulations."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.functions.columns import range_of
from evenkeel.functions.special import kolmogorov_tail, t_cdf, t_ppf
from evenkeel.operators import geometry as G
from evenkeel.operators import inference as I
from evenkeel.operators import metrics as M
from evenkeel.operators import prep as P
from evenkeel.operators import ranking as R
from evenkeel.operators import recode as K
from evenkeel.operators import splits as S
from evenkeel.operators import study as Y
from evenkeel.operators import transforms as X
from evenkeel.sources import tabular


def test_t_quantiles():
    assert t_ppf(0.975, 20) == pytest.approx(2.086, abs=5e-4)
    assert t_ppf(0.975, 1) == pytest.approx(12.706, abs=5e-4)
    assert t_cdf(0, 7) == pytest.approx(0.5)
    assert kolmogorov_tail(1.3581) == pytest.approx(0.05, abs=1e-4)


def test_hand_survey_metrics(spark):
    df = spark.createDataFrame(list(zip([1, 1, 0, 0], [1, 0, 0, 1], [10, 10, 30, 10], strict=True)), "y int, q int, w int").withColumn("all", F.lit(1))
    r = M.weighted_confusion(df, ["all"], q="q").first()
    assert (r.tpr, r.fpr, r.ba) == (0.5, 0.25, 0.625) and r.sr == pytest.approx(1 / 3)


def test_hand_taylor(spark):
    rows = [(1, 10, 1, 0.2), (1, 11, 1, 0.6), (2, 20, 1, 0.4), (2, 21, 1, 0.8)] + [(s, p, 0, 0.5) for s, p in ((1, 10), (1, 11), (2, 20), (2, 21))]
    df = spark.createDataFrame([(*r, "g", 1.0) for r in rows], "stratum int, psu int, y int, q double, seg string, w double")
    t = I.psu_totals(df, ["g"], {"m": F.col("q")}, F.lit(True))
    var = {r.rate: r["var"] for r in I.taylor_variance(I.taylor_scores(t)).collect()}
    assert var["TPR"] == pytest.approx(0.02) and I.degrees_of_freedom(df) == 2
    cov = {(r.rate_a, r.rate_b): r["cov"] for r in I.taylor_covariance(I.taylor_scores(t)).collect()}
    assert all(cov[r, r] == pytest.approx(v) for r, v in var.items())
    with pytest.raises(ValueError, match="NOT_ESTIMABLE"):
        I.degrees_of_freedom(df.filter("psu <> 11"))


def test_domain_keeps_empty_psus(spark):
    df = spark.createDataFrame([(1, p, y, 0.3, "g", 2.0, p != 3) for p in (1, 2, 3) for y in (0, 1)], "stratum int, psu int, y int, q double, seg string, w double, d boolean")
    t = I.psu_totals(df, ["g", "absent"], {"m": F.col("q")}, F.col("d"))
    assert t.filter("psu = 3").count() == len(I.rate_names(["g", "absent"])) and t.filter("psu = 3 and (num <> 0 or den <> 0)").count() == 0
    assert {r.status for r in I.bootstrap_inference(I.bootstrap_metrics(t, I.bootstrap_factors(df, 20)), I.point_metrics(t), ["eo"], 20, 2).collect()} == {"NOT_ESTIMABLE"}


def test_two_bootstraps_agree(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i % 4), int(i % 3), int(rng.integers(2)), float(rng.random()), "ab"[int(rng.integers(2))], float(rng.random() + 0.1)) for i in range(300)]
    df = spark.createDataFrame(rows, "stratum int, psu int, y int, q double, seg string, w double")
    t, f = I.psu_totals(df, ["a", "b"], {"m": F.col("q"), "n": 1 - F.col("q")}, F.lit(True)), I.bootstrap_factors(df, 15)
    a = {(r.replicate, r.model): (r.ba, r.dp, r.eo) for r in I.bootstrap_metrics(t, f).collect()}
    b = {(r.replicate, r.model): (r.ba, r.dp, r.eo) for r in I.bootstrap_metrics(t, f, cells=0).collect()}
    assert len(a) == 30 and all(a[k] == pytest.approx(b[k]) for k in b)
    # replicate weights on rows give the same
    rep = df.join(f.filter("replicate = 3"), ["stratum", "psu"]).withColumn("w", F.col("w") * F.col("factor")).withColumn("all", F.lit(1))
    assert M.weighted_confusion(rep, ["all"], q="q").first().ba == pytest.approx(a[3, "m"][0])


def test_two_bootstraps_agree_on_empty_rates(spark):
    """A group in one PSU, without a positive: no TPR, so no eo; dp wherever that PSU is drawn."""
    rows = [(i % 2, i // 2 % 3, i % 5 % 2, (i % 7) / 7, "ab"[i % 3 % 2], 1.0) for i in range(120)] + [(0, 0, 0, 0.4, "c", 1.0)]
    df = spark.createDataFrame(rows, "stratum int, psu int, y int, q double, seg string, w double")
    t, f = I.psu_totals(df, ["a", "b", "c"], {"m": F.col("q")}, F.lit(True)), I.bootstrap_factors(df, 15)
    a, b = ({r.replicate: (r.ba, r.dp, r.eo) for r in I.bootstrap_metrics(t, f, cells=c).collect()} for c in (I.MATRIX_CELLS, 0))
    assert len(a) == 15 and a.keys() == b.keys()
    for k, row in a.items():
        assert row[2] is None and all((x is None) == (y is None) and (x is None or x == pytest.approx(y)) for x, y in zip(row, b[k], strict=True))
    assert len({row[1] is None for row in a.values()}) == 2


def golden(spark):
    return spark.createDataFrame([("o", "p", "n", f, float(g)) for f, g in zip("abcd", (1, 2, 4, 8), strict=True)], "attr string, grp_a string, grp_b string, feature string, g double")


def test_golden_distances(spark):
    d = {(r.node_a, r.node_b): r.d for r in G.distances(golden(spark), ["attr"]).collect()}
    assert d["a", "b"] == pytest.approx(0.1574088938392963) and d["a", "origin"] == pytest.approx(0.8404450029373088)
    assert len(d) == 10 and G.w_max(golden(spark), ["attr"]).first().w == pytest.approx(math.sqrt(85 / 4))


@pytest.mark.parametrize("most", [0, 1, 2, 3, 9])
@pytest.mark.parametrize("aggregate", ["mean_pair", "author_max_pair"])
def test_distances_equal_enumeration(spark, most, aggregate):
    g = {("p", "n"): dict(zip("abcd", (1.0, 2.0, 4.0, 8.0), strict=True)), ("p", "z"): dict(zip("abcd", (3.0, 0.5, 2.0, 0.0), strict=True))}
    df = spark.createDataFrame([("o", *k, f, v) for k, x in g.items() for f, v in x.items()], "attr string, grp_a string, grp_b string, feature string, g double")
    got = {(r.node_a, r.node_b): r.d for r in G.distances(df, ["attr"], aggregate, most=most).collect()}
    rms = lambda x, names: math.sqrt(sum(x[f] ** 2 for f in names) / len(names)) if names else 0.0
    for a in "abcd":
        for b in [*[f for f in "abcd" if f > a], "origin"]:
            rest = [f for f in "abcd" if f not in (a, b)]
            values = []
            for k in range(max(0, len(rest) - most), len(rest) + 1):
                for s in combinations(rest, k):
                    v1, v2 = ([rms(x, [*s, *more]) for x in g.values()] for more in ([a], [b] if b != "origin" else []))
                    values.append(abs(max(v1) - max(v2)) if aggregate == "author_max_pair" else np.mean([abs(p - q) for p, q in zip(v1, v2, strict=True)]))
            assert got[a, b] == pytest.approx(np.mean(values))
    with pytest.raises(ValueError, match="contexts"):
        G.distances(df, ["attr"], most=3, limit=5)


def test_embedding_of_an_embeddable_matrix(spark):
    points = {"a": (3.0, 0.0), "b": (0.0, 4.0), "origin": (0.0, 0.0), "c": (3.0, 4.0)}
    names = ["a", "b", "c", "origin"]
    rows = [("o", x, y, math.dist(points[x], points[y])) for i, x in enumerate(names) for y in names[i + 1 :]]
    df = spark.createDataFrame(rows, "attr string, node_a string, node_b string, d double")
    got = {r.feature: r for r in G.embed(df, ["attr"], dims=None).collect()}
    assert {k: round(r.dphi, 4) for k, r in got.items()} == {"a": 3.0, "b": 4.0, "c": 5.0} and got["a"].dim == 2
    zero = G.embed(df.withColumn("d", F.lit(0.0)), ["attr"]).collect()
    assert all(r.dphi == 0 for r in zero)
    turned = {r.feature: r.coord for r in G.embed(df, ["attr"], rotate=True).collect()}
    assert turned["c"][0] == pytest.approx(5, abs=1e-3) and abs(turned["c"][1]) < 1e-6


def test_weighting_laws(spark):
    rng = np.random.default_rng(1)
    rows = [("xyz"[int(rng.integers(3))], "pq"[int(rng.integers(2))], float(rng.random()), int(rng.integers(1, 4))) for _ in range(200)]
    df = spark.createDataFrame(rows, "c string, o string, x double, k int")

    def g(frame, w=None):
        both = G.div_cat(G.cells(frame, ["o"], ["c"], w)).unionByName(G.div_num(G.moments(frame, ["o"], ["x"], w)))
        return {r.feature: r.g for r in both.collect()}

    assert g(df.withColumn("w", F.lit(7.0)), "w") == pytest.approx(g(df))  # equal weights
    copies = df.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("k"))))
    assert g(df.withColumn("w", F.col("k").cast("double")), "w") == pytest.approx(g(copies))  # whole weights are copies


def test_nearest_neighbour_divergence(spark):
    rng = np.random.default_rng(2)
    rows = [("ab"[int(rng.integers(2))], float(round(rng.random(), 2))) for _ in range(150)]
    df = spark.createDataFrame(rows, "o string, x double")
    want = np.mean([min(abs(x - z) for p, z in rows if p != o) for o, x in rows])
    assert G.div_nearest(df, "o", "x", "a", "b", ranges=7).first().g == pytest.approx(want)


def test_nearest_in_several_dimensions(spark):
    rng = np.random.default_rng(5)
    rows = [("ab"[int(rng.integers(2))], *map(float, rng.random(2).round(1) * (1 if i else 30))) for i in range(120)]
    df = spark.createDataFrame([*rows, ("a", None, 1.0)], "o string, x double, y double")
    want = np.mean([min(math.dist(r[1:], z[1:]) for z in rows if z[0] != r[0]) for r in rows])
    assert Y.nearest_other_group(df, "o", "a", "b", ["x", "y"]).first().g == pytest.approx(want)
    assert Y.nearest_other_group(df.filter("o = 'a'"), "o", "a", "b", ["x", "y"]).first().g is None


def test_rank_metrics_by_hand(spark):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(2)), float(rng.integers(12) / 11)) for _ in range(200)]
    df = spark.createDataFrame(rows, "y int, p1 double").withColumn("all", F.lit(1))
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    want = np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg])
    assert R.auroc(df, ["all"]).first().auroc == pytest.approx(want) == R.auroc(df, []).first().auroc
    best = R.threshold_search_ba(df, ["all"]).first()
    grid = sorted({0.0, 1.0, *[(a + b) / 2 for a, b in zip(sorted({p for _, p in rows}), sorted({p for _, p in rows})[1:], strict=False)]})
    ba = {t: (np.mean([p >= t for p in pos]) + np.mean([p < t for p in neg])) / 2 for t in grid}
    assert best.ba == pytest.approx(max(ba.values())) and ba[min(grid, key=lambda t: abs(t - best.threshold))] == pytest.approx(best.ba)


def test_rank_metrics_of_scores_of_any_range(spark):
    """Margins keep their order and are dealt over many ranges; infinite and undefined ones are in the last."""
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(2)), float(x)) for x in [*rng.normal(scale=30, size=150).round(), *rng.random(30).round(2), -1e300, 1e300, 0.0, 1.0]]
    df = spark.createDataFrame(rows, "y int, p1 double")
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    assert R.auroc(df, []).first().auroc == pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg]))
    points = sorted({p for _, p in rows})
    want = max(abs(np.mean([a <= t for a in pos]) - np.mean([b <= t for b in neg])) for t in points)
    assert R.ks_two_sample(df, []).first().ks == pytest.approx(want)
    best = R.threshold_search_ba(df.withColumn("all", F.lit(1)), ["all"]).first()
    grid = [0.0, 1.0, *[(a + b) / 2 for a, b in zip(points, points[1:], strict=False)]]
    assert best.ba == pytest.approx(max((np.mean([p >= t for p in pos]) + np.mean([p < t for p in neg])) / 2 for t in grid))
    x = spark.createDataFrame([(v,) for v in sorted([*points, -math.inf, math.inf])] + [(math.nan,)], "x double")
    ranges = [r[0] for r in x.select(range_of(F.col("x"))).collect()]
    assert ranges == sorted(ranges) and len(set(ranges)) > 60 and ranges[-1] == ranges[-2]


def test_splits(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("s"))
    out = S.stratified_split(df, ["s"], "k")
    again = S.stratified_split(df.repartition(7), ["s"], "k")
    assert out.exceptAll(again).isEmpty()
    assert {r.status for r in S.split_audit(out, ["s"]).collect()} == {"PASS"}
    ranks = S.hash_rank(df, ["s"], "k", 0, ranges=5).filter("s = 1").orderBy("rank")
    assert [r["rank"] for r in ranks.collect()] == list(range(1, 334))


def test_recodes_refuse_undeclared_codes(spark):
    df = spark.createDataFrame([(1,), (2,), (9,), (None,)], "c int")
    assert [r[0] for r in df.select(K.recode_binary(F.col("c"), [9])).collect()] == [1, 0, None, None]
    with pytest.raises(Exception, match="undeclared code 9"):
        df.select(K.recode_binary(F.col("c"), [7])).collect()
    assert spark.createDataFrame([("1.0",), ("1.5",), ("x",)], "c string").select(K.canonical_code(F.col("c"))).first()[0] == 1


def test_transform_states(spark):
    trace = [("c", "merge", {"3": "1"}), ("x", "power", 3), ("c", "merge", {"1": "0"}), ("x", "power", 5), ("c", "drop", None), ("c", "merge", {"0": "9"})]
    states = X.replay_states(trace)
    assert states[3]["c"] == {"merge": {"3": "0", "1": "0"}} and states[4]["x"] == {"power": 5} and states[6]["c"] == "dropped"
    row = spark.range(1).select(X.compose_mapping(F.create_map(F.lit("3"), F.lit("1")), F.create_map(F.lit("1"), F.lit("0"))).alias("m")).first()
    assert row.m == {"3": "0", "1": "0"}
    assert spark.range(1).select(X.overflows(F.lit(10.0), 39), X.overflows(F.lit(10.0), 37), X.power(F.lit(-2.0), 3)).first()[:] == (True, False, -8.0)


def test_levels_are_numbered_over_ranges(spark):
    df = spark.range(4000).select(F.concat(F.lit("v"), (F.col("id") * 37 % 1500).cast("string")).alias("c")).unionByName(spark.createDataFrame([(None,)], "c string"))
    names = sorted({f"v{i}" for i in range(1500)})
    assert {r.level: r.code for r in P.levels(df, "c").collect()} == {x: i for i, x in enumerate(names)}
    seen = df.filter("c < 'v5'")
    coded = P.label_encode(df, seen, "c")
    known = [x for x in names if x < "v5"]
    got = {(r.c, r.c_code, r.c_level) for r in P.label_decode(coded, seen, "c", "c_code").collect()}
    assert got == {(x, known.index(x), x) if x in known else (x, len(known), None) for x in [*names, None]}
    assert P.levels(df.limit(0), "c").collect() == [] and {r.c_code for r in P.label_encode(df, df.limit(0), "c").collect()} == {0}


def test_prep(spark):
    df = spark.createDataFrame([(i, float(i), "ab"[i % 2]) for i in range(10)], "k int, x double, c string")
    assert {r.c: r.c_code for r in P.label_encode(df, df.filter("c = 'a'"), "c").collect()} == {"a": 0, "b": 1}
    with pytest.raises(ValueError, match="may not be fitted"):
        P.fit_guard(df, "c", ["a"])
    with pytest.raises(Exception, match="no valid row"):
        P.median_impute(df, df, "x", 50, 60).collect()
    cell = spark.createDataFrame([("f", "a", 0, 5), ("f", "b", 1, 5)], "feature string, category string, y int, n int")
    assert P.nmi(cell, ["feature"]).first().nmi == pytest.approx(1.0)


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string")
    for kind in ("csv", "json", "parquet"):
        path = f"{tmp_path}/t.{kind}"
        df.write.format(kind).option("header", True).save(path)
        assert sorted((r.i, r.s) for r in tabular.load(spark, path).collect()) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError, match="no reader"):
        tabular.load(spark, "x.xlsx")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        tabular.load(spark, f"{tmp_path}/none.parquet")
    path = f"{tmp_path}/g"
    assert tabular.write_parquet_guarded(df, path) and not tabular.write_parquet_guarded(df, path)
    with pytest.raises(ValueError, match="other content"):
        tabular.write_parquet_guarded(df.limit(1), path)
    assert tabular.write_parquet_guarded(df.limit(1), path, force=True)
    schema = df.schema
    assert tabular.load_declared_csv(spark, f"{tmp_path}/t.csv", schema).count() == 2
    with pytest.raises(ValueError, match="missing columns"):
        tabular.load_declared_csv(spark, f"{tmp_path}/t.csv", spark.createDataFrame([], "i int, z int").schema)


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 7
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100
