"""Exact quantiles against numpy, in one round and in many."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.functions import quantiles as Q
from evenkeel.operators import geometry as G

PROBS = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]


@pytest.mark.parametrize("most", [3, 50_000])
def test_quantiles_equal_numpy(spark, monkeypatch, most):
    """Heavy tails, repeated values, a key of one value, a null key, null values; few and many rounds."""
    monkeypatch.setattr(Q, "RANGES", 8 if most == 3 else 256)
    rng = np.random.default_rng(1)
    data = {"tail": np.concatenate([rng.normal(size=200), 10.0 ** rng.integers(-300, 300, 100)]), "same": np.full(150, 2.5), "one": np.array([7.0])}
    data[None] = rng.integers(0, 4, 301).astype(float)
    rows = [(k, float(v)) for k, x in data.items() for v in x] + [("tail", None), ("nothing", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    got = {r.k: r.q for r in Q.exact_quantiles(df, ["k"], F.col("x"), PROBS, most=most).collect()}
    assert set(got) == set(data)
    want = {r.k: r.q for r in df.groupBy("k").agg(F.percentile("x", F.array(*[F.lit(p) for p in PROBS])).alias("q")).filter("q is not null").collect()}
    assert got == want
    for k, x in data.items():
        assert np.allclose(got[k], np.quantile(x, PROBS))
    whole = Q.exact_quantiles(df, [], F.col("x"), [0.5], most=most).collect()
    assert len(whole) == 1 and whole[0].q[0] == df.agg(F.percentile("x", 0.5)).first()[0]


def test_without_a_value(spark):
    none = spark.createDataFrame([], "k string, x double")
    assert Q.exact_quantiles(none, ["k"], F.col("x"), [0.5]).collect() == []
    assert [r.q for r in Q.exact_quantiles(none, [], F.col("x"), [0.5]).collect()] == [None]
    out = spark.createDataFrame([("a",), (None,)], "k string")
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "k string, x double")
    assert {r.k: r.m for r in Q.with_quantiles(out, df, ["k"], F.col("x"), [0.5], ["m"]).collect()} == {"a": None, None: 1.5}


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(Q, "BROADCAST_KEYS", 0)
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").cast("double").alias("x"))
    got = {r.k: r.q for r in Q.exact_quantiles(df, ["k"], F.col("x"), [0.5], most=5).collect()}
    assert got == {k: [float(np.median(np.arange(k, 1000, 7)))] for k in range(7)}


def test_nearest_divergence_of_heavy_tails(spark):
    rng = np.random.default_rng(2)
    rows = [("ab"[int(rng.integers(2))], float(np.round(rng.pareto(0.4), 2))) for _ in range(250)]
    want = np.mean([min(abs(x - z) for p, z in rows if p != o) for o, x in rows])
    assert G.div_nearest(spark.createDataFrame(rows, "o string, x double"), "o", "x", "a", "b", ranges=7).first().g == pytest.approx(want)
