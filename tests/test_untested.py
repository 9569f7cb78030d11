"""Operators that no SQL covers: laws and hand-made versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.operators import contracts as C
from evenkeel.operators import geometry as G
from evenkeel.operators import learners as L
from evenkeel.operators import metrics as M
from evenkeel.operators import prep as P
from evenkeel.operators import ranking as R
from evenkeel.operators import search as S
from evenkeel.operators import study as Y


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 300)
    x = rng.normal(size=(300, 2)) + 2.2 * y[:, None] * [1, -1]
    rows = [(i, float(a), float(b), int(c), "train" if i % 3 else "test") for i, ((a, b), c) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "k long, a double, b double, y int, split string").cache()


@pytest.mark.parametrize("kind", ["lr", "l1", "tree", "rf", "gbt", "nb", "svm", "mlp"])
def test_classifiers_learn_and_keep_rows(data, kind):
    fit, test = data.filter("split = 'train'"), data.filter("split = 'test'")
    got = L.fit_score(test, fit, ["a", "b"], "y", kind).cache()
    assert got.count() == test.count() and got.filter("p_event < 0 or p_event > 1 or p_event is null").count() == 0
    assert R.auroc(got, [], "y", "p_event").first().auroc > 0.9
    again = {r.k: r.p_event for r in L.fit_score(test.repartition(3), fit, ["a", "b"], "y", kind).collect()}
    assert all(again[r.k] == pytest.approx(r.p_event) for r in got.collect())


def test_logistic_coefficients_meet_their_conditions(data):
    """The mean gradient of the fit is that of its penalty."""
    fit = data.filter("split = 'train'")
    a, _ = L.with_features(fit, fit, ["a", "b"], "y")
    model = L.classifier("lr", 2).fit(a)
    from pyspark.ml.functions import vector_to_array

    z = np.array([r.x for r in a.select(vector_to_array("features").alias("x")).collect()])
    y = np.array([r.label for r in a.select("label").collect()])
    b = model.coefficients.toArray()
    p = 1 / (1 + np.exp(-(z @ b + model.intercept)))
    assert np.allclose(z.T @ (p - y) / len(y) + 1e-3 * b, 0, atol=1e-3) and abs((p - y).mean()) < 1e-3


def test_adaboost_beats_one_tree_and_weighs_by_error(data):
    fit, test = data.filter("split = 'train'"), data.filter("split = 'test'")
    got = L.adaboost_score(test, fit, "k", ["a", "b"], "y", rounds=3)
    assert got.columns == [*test.columns, "p_event"] and R.auroc(got, [], "y", "p_event").first().auroc > 0.9


def test_frozen_policy_scores_alike_after_a_round_trip(spark, data, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.feature import VectorAssembler

    df = data.withColumn("label", F.col("y").cast("double")).withColumn("weight", F.lit(1.0))
    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"), L.classifier("lr", 2)]).fit(df)
    model.write().save(f"{tmp_path}/policy")
    before = {r.k: r.p_event for r in L.positive_probability(model.transform(df)).collect()}
    after = {r.k: r.p_event for r in L.positive_probability(PipelineModel.load(f"{tmp_path}/policy").transform(df)).collect()}
    assert before == after


def test_adaptive_phi():
    assert S.adaptive_phi(0.5, 1.0, 0.95) == pytest.approx(0.475)  # progress of a twentieth
    assert S.adaptive_phi(0.5, 1.0, 0.89) == 0.5 and S.adaptive_phi(0.5, 1.0, 0.2) == 0.5
    assert S.adaptive_phi(0.5, 0.0, 0.0) == pytest.approx(0.475)


def test_digest_is_free_of_order(spark):
    df = spark.range(50).select((F.col("id") % 3).alias("year"), F.col("id").alias("key"))
    one = C.cohort_digest(df, ["year", "key"]).first()
    assert one == C.cohort_digest(df.orderBy(F.desc("key")).repartition(7), ["year", "key"]).first()
    other = C.cohort_digest(df.withColumn("key", F.when(F.col("key") == 7, 99).otherwise(F.col("key"))), ["year", "key"]).first()
    assert other.n == one.n == 50 and other.digest != one.digest
    twice = C.cohort_digest(df.unionByName(df), ["year", "key"]).first()
    assert twice.n == 2 * one.n and int(twice.digest) == 2 * int(one.digest)
    assert tuple(C.cohort_digest(df.limit(0), ["year", "key"]).first()) == (0, "0")
    apart = [C.cohort_digest(df.sparkSession.createDataFrame([r], "a string, b string"), ["a", "b"]).first().digest for r in (("12", "3"), ("1", "23"), (None, "123"), ("123", None), ("", "123"))]
    assert len(set(apart)) == 5


def test_rank_protected_auto_takes_each_column_in_turn(spark):
    rng = np.random.default_rng(3)
    rows = [("pq"[i % 2], "uv"[i // 2 % 2], "xyz"[int(rng.integers(3))], float(i % 2) + float(rng.normal() * 0.1), float(rng.normal())) for i in range(200)]
    df = spark.createDataFrame(rows, "a string, b string, c string, x double, z double")
    got = {r.attr: (r.worst, r["rank"]) for r in Y.rank_protected_auto(df, ["a", "b", "c"], ["x", "z"], 3).collect()}
    for attr in "abc":
        g = G.div_cat(G.cells(df, [attr], [c for c in "abc" if c != attr])).unionByName(G.div_num(G.moments(df, [attr], ["x", "z"])))
        worst = G.embed(G.distances(g, ["attr"]), ["attr"]).agg(F.max("dphi")).first()[0]
        assert got[attr][0] == pytest.approx(worst)
    assert got["a"][1] == 1 and sorted(v[1] for v in got.values()) == [1, 2, 3]  # x separates the groups of a
    assert Y.rank_protected_auto(df, ["a", "b", "c"], ["x", "z"], 1).count() == 1


def test_train_epsilon_is_of_the_fit_rows_only(spark):
    rows = [(y, "pq"[i % 2], float(i % 7 + (y == 1999) * (i % 2) * 50)) for y in (1995, 1999) for i in range(60)]
    df = spark.createDataFrame(rows, "year int, a string, x double")

    def epsilon(frame):
        table = G.embed(G.distances(G.div_num(G.moments(frame, ["a"], ["x"])), ["attr"]), ["attr"])
        return G.epsilon_ratio(table, ["attr"], "dphi", 0.5).first().epsilon

    fit = P.fit_guard(df.filter("year = 1995"), "year", [1995])
    assert epsilon(fit) == pytest.approx(epsilon(df.filter("year = 1995"))) != pytest.approx(epsilon(df))
    with pytest.raises(ValueError, match="may not be fitted"):
        P.fit_guard(df, "year", [1995])


def test_elbow_takes_the_dimension_of_the_points(spark):
    rng = np.random.default_rng(0)
    for true in (1, 3):
        points = {n: rng.normal(size=true) * 3 for n in "abcdef"} | {"origin": np.zeros(true)}
        names = sorted(points)
        rows = [("o", x, y, float(np.linalg.norm(points[x] - points[y]))) for i, x in enumerate(names) for y in names[i + 1 :]]
        got = G.embed(spark.createDataFrame(rows, "attr string, node_a string, node_b string, d double"), ["attr"], dims=None).collect()
        assert {r.dim for r in got} == {true} and all(r.stress < 0.01 for r in got)
        assert all(r.dphi == pytest.approx(np.linalg.norm(points[r.feature]), abs=0.05) for r in got)


def test_representation_metrics_by_hand(data):
    df = data.withColumn("s", 1 / (1 + F.exp(-F.col("a")))).withColumn("yhat", (F.col("s") >= 0.5).cast("int")).withColumn("w", F.lit(1.0)).withColumn("all", F.lit(1)).withColumn("g", F.col("k") % 2)
    u = R.utility_metrics(df, ["all"], "y", "s", "yhat").first()
    rows = df.collect()
    s, y, q = (np.array([getattr(r, c) for r in rows]) for c in ("s", "y", "yhat"))
    assert u.ba == pytest.approx((q[y == 1].mean() + 1 - q[y == 0].mean()) / 2) and u.accuracy == pytest.approx((q == y).mean())
    assert u.auroc == pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]]))
    assert R.brier(df, ["all"], "y", "s").first().brier == pytest.approx(((y - s) ** 2).mean())
    gap = M.fairness_gaps(M.group_metrics(df, ["g"])).first()
    g = np.array([r.g for r in rows])
    assert gap.dp == pytest.approx(abs(q[g == 0].mean() - q[g == 1].mean()))


def test_reweighing_makes_the_cells_independent(data):
    df = data.withColumn("g", F.when(F.col("a") > 1, "m").otherwise("f")).withColumn("w", F.lit(1.0) + F.col("k") % 3)
    factor = L.reweighing(df, "g", "y", "w")
    cell = {(r.g, r.y): r.s for r in df.join(factor, ["g", "y"]).groupBy("g", "y").agg(F.sum(F.col("w") * F.col("factor")).alias("s")).collect()}
    total = sum(cell.values())
    for g, y in cell:
        assert cell[g, y] == pytest.approx(sum(v for k, v in cell.items() if k[0] == g) * sum(v for k, v in cell.items() if k[1] == y) / total)
