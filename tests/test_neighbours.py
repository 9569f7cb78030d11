"""Nearest rows against all distances, whatever the distribution."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.operators import learners as L
from evenkeel.operators import neighbours as B
from evenkeel.operators import study as Y


def frame(spark, x, labels=None):
    rows = [(i, i, float(labels[i]) if labels is not None else 0.0, [float(v) for v in p]) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "row long, key long, label double, x array<double>")


def brute(q, p, k, own):
    d = np.sqrt(((q[:, None] - p[None]) ** 2).sum(2))
    if own:
        np.fill_diagonal(d, np.inf)
    out = []
    for row in d:
        order = np.lexsort((np.arange(len(row)), row))[:k]
        out.append([(row[j], int(j)) for j in order if np.isfinite(row[j])])
    return out


@pytest.mark.parametrize("kind", ["tails", "copies", "line", "five"])
def test_exact_in_bounded_cells(spark, monkeypatch, kind):
    """Outliers at 100 times the spread, a point that a third of all rows share, one coordinate that is constant, five dimensions."""
    monkeypatch.setattr(B, "POINTS", 8)
    monkeypatch.setattr(B, "WAYS", 4)
    monkeypatch.setattr(B, "SLICE", 50)
    rng = np.random.default_rng(3)
    n = 400
    x = rng.normal(size=(n, 5 if kind == "five" else 2))
    if kind == "tails":
        x[::20] *= 100 * rng.pareto(1, (20, 1))
    if kind == "copies":
        x[::3] = [0.5, 0.5]
    if kind == "line":
        x[:, 1] = 7.0
    df = frame(spark, x).repartition(3)
    got = {r.row: [(p.d, p.key) for p in r.near] for r in B.nearest(df, df, x.shape[1], 5, True).collect()}
    want = brute(x, x, 5, True)
    assert len(got) == n
    for i in range(n):
        assert [k for _, k in got[i]] == [k for _, k in want[i]] and np.allclose([d for d, _ in got[i]], [d for d, _ in want[i]])
    cells, boxes = B.cells_of(df.select("key", "label", "x"), x.shape[1], n)
    largest = cells.groupBy("cell").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert largest <= (40 if kind != "copies" else 200) and len(boxes.leaf) >= 20
    q, _ = boxes.reach(x, 6)
    if kind == "tails":
        assert np.bincount(q).mean() < len(boxes.leaf) / 4  # outliers do not search everything


def test_fewer_points_than_asked(spark):
    x = np.array([[0.0], [1.0], [5.0]])
    df = frame(spark, x)
    got = {r.row: [p.key for p in r.near] for r in B.nearest(df, df, 1, 5, True).collect()}
    assert got == {0: [1, 2], 1: [0, 2], 2: [1, 0]}
    assert B.nearest(df, df.limit(0), 1, 5, False).collect() == []


def test_other_group_of_outliers(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(150, 4)).round(1)
    x[::25] *= 300
    o = rng.choice(["a", "b"], 150)
    df = spark.createDataFrame([(str(g), *map(float, p)) for g, p in zip(o, x, strict=True)], "o string, p double, q double, r double, s double")
    want = np.mean([min(np.linalg.norm(x[i] - x[j]) for j in range(150) if o[j] != o[i]) for i in range(150)])
    assert Y.nearest_other_group(df, "o", "a", "b", ["p", "q", "r", "s"]).first().g == pytest.approx(want)


def test_bound_of_the_home_cell_leaves_few_cells(spark, monkeypatch):
    """A query is asked in its home cell and where the k-th distance found there reaches."""
    monkeypatch.setattr(B, "POINTS", 256)
    x = np.random.default_rng(4).normal(size=(3000, 2))
    cells, boxes = B.cells_of(frame(spark, x).select("key", "label", "x"), 2, len(x))
    cell = dict(cells.select("key", "cell").toPandas().itertuples(index=False))
    home = boxes.leaf[boxes.home(x)]
    mine = np.array([cell[i] for i in range(len(x))])
    bound = np.empty(len(x))
    for c in np.unique(home):
        z = x[mine == c]
        d = np.sort(np.sqrt(((x[home == c][:, None] - z[None]) ** 2).sum(2)), 1)
        bound[home == c] = d[:, 5] if d.shape[1] > 5 else np.inf
    q, leaf = boxes.reach(x, 6, bound)
    assert len(q) < 2 * len(x) and len(q) < len(boxes.reach(x, 6)[0]) / 2
    for i in range(0, len(x), 50):
        d = np.sqrt(((x[i] - x) ** 2).sum(1))
        assert {cell[j] for j in np.argsort(d)[:6]} <= set(leaf[q == i])


@pytest.mark.parametrize("pairs", [1, 700, 2_000_000])
def test_leaves_of_a_cell_are_exact(monkeypatch, pairs):
    """However few pairs are taken side by side."""
    monkeypatch.setattr(B, "PAIRS", pairs)
    rng = np.random.default_rng(6)
    z = rng.integers(0, 12, (500, 2)).astype(float)  # ties
    x = np.vstack([z[:100], rng.normal(size=(50, 2)) * 30])
    own = np.arange(500) // 2
    mine = np.append(own[:100], np.full(50, -2))
    q, p, d = B.Leaves(z, 10).nearest(x, 4, 6, np.full(150, np.inf), mine, own)
    for i in range(150):
        dist = np.sqrt(((x[i] - z) ** 2).sum(1))
        want = [j for j in np.lexsort((np.arange(500), dist)) if own[j] != mine[i]][:4]
        assert list(p[q == i]) == want and np.allclose(d[q == i], dist[want])


@pytest.mark.parametrize("points", [8, 8192])
def test_copies_of_places_and_keys(spark, monkeypatch, points):
    """Places that many points share, keys that come twice or are null, distances that tie."""
    monkeypatch.setattr(B, "POINTS", points)
    monkeypatch.setattr(B, "SLICE", 40)
    rng = np.random.default_rng(9)
    n = 300
    x = rng.integers(0, 4, (n, 2)).astype(float)
    x[::2] = [1.0, 2.0]
    keys = [None if i % 29 == 0 else int(i // 2 if i % 5 == 0 else i) for i in rng.permutation(n)]
    labels = [float(v) for v in rng.integers(0, 2, n)]
    rows = [(i, keys[i], labels[i], [float(v) for v in x[i]]) for i in range(n)]
    df = spark.createDataFrame(rows, "row long, key long, label double, x array<double>")
    got = {r.row: [(p.d, p.key, p.label) for p in r.near] for r in B.nearest(df, df, 2, 5, True).collect()}
    assert len(got) == n
    for i in range(n):
        every = [(float(np.linalg.norm(x[i] - x[j])), keys[j] is not None, keys[j] or 0, labels[j]) for j in range(n) if keys[j] is None or keys[j] != keys[i]]
        assert got[i] == [(d, k if there else None, v) for d, there, k, v in sorted(every)[:5]]


def test_coordinates_that_are_not_finite_hide_no_other_point(spark):
    x = np.array([[0.0, 0.0], [1.0, 0.0], [np.nan, 1.0], [np.inf, 0.0], [5.0, 0.0]])
    df = frame(spark, x)
    got = {r.row: [p.key for p in r.near] for r in B.nearest(df, df, 2, 2, True).collect()}
    assert got == {0: [1, 4], 1: [0, 4], 4: [1, 0]}
    kept = {r.row: (r.label, len(r.near)) for r in B.nearest(df, df, 2, 2, True, ["label"]).collect()}
    assert kept == {0: (0.0, 2), 1: (0.0, 2), 2: (0.0, 0), 3: (0.0, 0), 4: (0.0, 2)}


def test_no_point_leaves_every_query_that_is_kept(spark):
    df = frame(spark, np.array([[0.0], [1.0]])).withColumn("name", F.concat(F.lit("n"), "row"))
    got = {r.row: (r.name, r.near) for r in B.nearest(df, df.limit(0), 1, 3, True, ["name"]).collect()}
    assert got == {0: ("n0", []), 1: ("n1", [])}


def test_knn_keeps_columns_and_null_keys(spark):
    df = spark.createDataFrame([(None if i == 2 else i, float(i), i % 2, f"n{i}") for i in range(4)], "k long, a double, y int, name string")
    got = {r.name: (r.k, r.p_event, r.neighbours) for r in L.knn_score(df, df.filter("k < 2"), "k", ["a"], "y", keep=["name"]).collect()}
    assert got == {"n0": (0, 1.0, 1), "n1": (1, 0.0, 1), "n2": (None, 0.5, 2), "n3": (3, 0.5, 2)}
