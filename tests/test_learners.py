"""Learners against a second formulation."""

import numpy as np
import pytest

from evenkeel.operators import learners as L


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    n = 200
    y = rng.integers(0, 2, n)
    x = rng.normal(size=(n, 2)) + y[:, None] * [0.8, -0.3]
    x[::50] *= 30  # outliers lie far from all
    x[3] = x[4]
    return spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "k long, a double, b double, y int"), x, y


def test_knn_is_exact_and_loses_no_row(data):
    df, x, y = data
    fit = df.filter("k < 120")
    z = (x - x[:120].mean(0)) / x[:120].std(0, ddof=1)
    got = {r.k: r for r in L.knn_score(df, fit, "k", ["a", "b"], "y", k=5).collect()}
    assert len(got) == 200
    for i in range(200):
        d = [(np.sqrt(((z[i] - z[j]) ** 2).sum()), j) for j in range(120) if j != i]
        want = np.mean([y[j] for _, j in sorted(d)[:5]])
        assert got[i].neighbours == 5 and abs(got[i].p_event - want) < 1e-9


@pytest.mark.parametrize(("quadratic", "reg"), [(False, 0.0), (True, 0.01)])
def test_discriminant_is_the_normal_posterior(data, quadratic, reg):
    df, x, y = data
    got = {r.k: r.p_event for r in L.discriminant_score(df, df, ["a", "b"], "y", quadratic, reg).collect()}
    log = []
    pooled = sum(np.cov(x[y == c].T, bias=True) * (y == c).mean() for c in (0, 1))
    for c in (0, 1):
        s = np.cov(x[y == c].T) if quadratic else pooled
        s = (1 - reg) * s + reg * np.eye(2)
        d = x - x[y == c].mean(0)
        log.append(-np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) / 2 - np.log(np.linalg.det(s)) / 2 + np.log((y == c).mean()))
    want = 1 / (1 + np.exp(log[0] - log[1]))
    assert max(abs(got[i] - want[i]) for i in range(200)) < 1e-9
