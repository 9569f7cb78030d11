"""Weighted searches, importance, checkpoints and whole arms against second formulations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.operators import importance as N
from evenkeel.operators import inference as I
from evenkeel.operators import metrics as M
from evenkeel.operators import search as S
from evenkeel.operators import study as Y


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    out = []
    for i in range(480):
        g, h = "ab"[i % 2], "uvw"[i % 3]
        c = "pqrs"[int(rng.choice(4, p=[0.5, 0.2, 0.2, 0.1] if g == "a" else [0.2, 0.2, 0.3, 0.3]))]
        x, z = float(rng.normal() + (g == "a")), float(rng.normal())
        y = int(rng.random() < 1 / (1 + np.exp(-(1.5 * x - 0.5 + (c == "p")))))
        out.append((i, g, h, c, x, z, y, float(1 + i % 3), i % 4, i // 4 % 3))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, g string, h string, c string, x double, z double, y int, w double, stratum int, psu int").repartition(3)


POWERS = [3.0, 1 / 3]


def searched(df, **kw):
    m = S.Mitigation(df, ["g", "h"], ["c"], ["x", "z"], "y", POWERS, mode="next", **kw)
    m.run()
    return m


def same(a, b):
    assert a.state == b.state and a.status == b.status and [t[:5] for t in a.trace] == [t[:5] for t in b.trace]
    assert all(p == pytest.approx(q) for s, t in zip(a.trace, b.trace, strict=True) for p, q in zip(s[5:7], t[5:7], strict=True))


def test_equal_weights_change_nothing_and_whole_ones_are_copies(frame):
    plain = searched(frame)
    assert plain.trace and len(plain.states) == 1 + sum(t[-1] == "ACCEPTED" for t in plain.trace)
    same(plain, searched(frame.withColumn("w", F.lit(2.5)), weight="w"))
    copies = frame.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))))
    same(searched(copies), searched(frame, weight="w"))


def test_bad_weights_are_refused(frame):
    with pytest.raises(ValueError, match="cannot be used"):
        searched(frame.withColumn("w", F.when(F.col("k") == 3, -1.0).otherwise(1.0)), weight="w")
    with pytest.raises(ValueError, match="cannot be used"):
        searched(frame.withColumn("w", F.when(F.col("g") == "a", 0.0).otherwise(1.0)), weight="w")


def split(frame):
    s = F.when(F.col("k") % 5 < 3, "train").when(F.col("k") % 5 == 3, "val").otherwise("test")
    return frame.withColumn("split", s)


def test_checkpoints_and_the_rule(spark, frame, rows):
    parts = split(frame)
    states = [{}, {"x": "dropped"}, {"x": "dropped", "c": "dropped", "z": "dropped"}]
    got = {r.state: r for r in Y.checkpoint_metrics(parts, states, ["g", "h"], ["c"], ["x", "z"], ["k", "y", "g", "h", "split"], "y").collect()}
    # without a feature all rows are decided alike
    assert got[2].eo == 0 and got[2].dp == 0
    val = [r for r in rows if r[0] % 5 == 3]
    assert got[2].accuracy in (pytest.approx(np.mean([r[6] for r in val])), pytest.approx(1 - np.mean([r[6] for r in val])))
    assert got[0].accuracy > got[2].accuracy
    table = spark.createDataFrame([(0, 0.8, 0.3), (1, 0.79, 0.2), (2, 0.79, 0.2), (3, 0.7, 0.0)], "state int, accuracy double, eo double")
    assert Y.pareto_checkpoint(table, 0.02).first().state == 1 and Y.pareto_checkpoint(table, 0.2).first().state == 3 and Y.pareto_checkpoint(table, 0.0).first().state == 0


def test_arm_has_all_methods_with_intervals(frame):
    cols = ["w", "stratum", "psu"]
    decided = Y.arm_decisions(frame, "k", "g", ["g", "h"], ["c"], ["x", "z"], "y", carry=cols, powers=POWERS).cache()
    assert decided.columns == ["k", "y", "g", "h", *cols, *Y.METHODS] and decided.count() == decided.select("k").distinct().count()
    for m in Y.METHODS:
        lo, hi = decided.agg(F.min(m), F.max(m)).first()
        assert 0 <= lo <= hi <= 1
    out = {(r.method, r.metric): r for r in Y.arm_inference(decided, list(Y.METHODS), ["a", "b"], "y", "g", "w", replicates=40).collect()}
    assert set(out) == {(m, k) for m in Y.METHODS for k in ("ba", "dp", "eo")}
    for m in Y.METHODS:
        one = M.weighted_confusion(decided.withColumn("all", F.lit(1)), ["all"], q=m).first()
        assert out[m, "ba"].value == pytest.approx(one.ba)
        sr = {r.g: r.v for r in decided.groupBy("g").agg((F.sum(F.col(m) * F.col("w")) / F.sum("w")).alias("v")).collect()}
        assert out[m, "dp"].value == pytest.approx(abs(sr["a"] - sr["b"]))
        assert all(r.taylor_lo <= r.value <= r.taylor_hi and r.boot_lo <= r.value <= r.boot_hi for k, r in out.items() if k[0] == m)
    alone = I.point_metrics(I.psu_totals(decided, ["a", "b"], {"m": F.col("bm")}, F.lit(True), "y", "g", "w")).first()
    assert alone.eo == pytest.approx(out["bm", "eo"].value)
    with pytest.raises(ValueError, match="no method"):
        Y.arm_decisions(frame, "k", "g", ["g"], ["c"], ["x"], "y", methods=["other"])


def standardised(rows):
    t = np.array([r[0] % 5 < 3 for r in rows])
    x = np.stack([np.array([r[4] for r in rows]), np.array([r[5] for r in rows]), *[np.array([float(r[3] == c) for r in rows]) for c in "pqrs"]], 1)
    return t, (x - x[t].mean(0)) / x[t].std(0, ddof=1), np.array([r[6] for r in rows])


def lasso(z, y, penalty):
    """Proximal gradient steps to the end."""
    b = np.zeros(z.shape[1] + 1)
    z1 = np.column_stack([z, np.ones(len(z))])
    step = 4 / np.linalg.eigvalsh(z1.T @ z1 / len(z))[-1]
    for _ in range(20_000):
        g = z1.T @ (1 / (1 + np.exp(-(z1 @ b))) - y) / len(z)
        u = b - step * g
        new = np.append(np.sign(u[:-1]) * np.maximum(np.abs(u[:-1]) - step * penalty, 0), u[-1])
        if np.abs(new - b).max() < 1e-12:
            break
        b = new
    return b


def test_l1_importance_against_proximal_steps(frame, rows):
    penalties = [0.2, 0.05, 0.01]
    got, chosen = N.l1_importance(split(frame), "k", ["c"], ["x", "z"], "y", penalties, folds=3)
    t, z, y = standardised(rows)
    fold = np.floor(np.array([(r[0] * 7919 % 1_000_003) / 1_000_003 for r in rows]) * 3).astype(int)
    loss = []
    for p in penalties:
        each = []
        for k in range(3):
            b = lasso(z[t & (fold != k)], y[t & (fold != k)], p)
            s = z[t & (fold == k)] @ b[:-1] + b[-1]
            each += list(np.logaddexp(0, s) - y[t & (fold == k)] * s)
        loss.append(np.mean(each))
    assert chosen == penalties[int(np.argmin(loss))]
    b = np.abs(lasso(z[t], y[t], chosen))
    # columns of a category sum to a constant: only what they say together is unique
    assert got["x"] == pytest.approx(b[0], abs=1e-4) and got["z"] == pytest.approx(b[1], abs=1e-4)
    again, _ = N.l1_importance(split(frame).repartition(7), "k", ["c"], ["x", "z"], "y", penalties, folds=3)
    assert again == pytest.approx(got, abs=1e-5)


def test_permutation_importance(frame, rows):
    parts = split(frame).select("k", "y", "split", "c", "x", "z")
    got = {r.feature: r.importance for r in N.permutation_importance(parts, "k", ["c"], ["x", "z"], "y", repeats=2).collect()}
    again = {r.feature: r.importance for r in N.permutation_importance(parts.repartition(6), "k", ["c"], ["x", "z"], "y", repeats=2).collect()}
    assert got == pytest.approx(again) and got["x"] > 0.1 > abs(got["z"]) and got["x"] > got["c"]
    # by hand: ranks by hash, donors by the next seeds' ranks
    t, z, y = standardised(rows)
    val = np.array([r[0] % 5 == 3 for r in rows])
    from evenkeel.operators.batch_fit import BatchFit, Design

    fit = BatchFit(Design(parts, {"m": {}}, ["c"], ["x", "z"], ["k", "y", "split"]), "y")
    b = fit.fits["m"]
    zz = np.column_stack([z[:, :2], z[:, 2:], np.zeros((len(z), 2)), np.ones(len(z))])  # no missing, no unknown
    auroc = lambda s, y: np.mean([(p > q) + (p == q) / 2 for p in s[y == 1] for q in s[y == 0]])
    keys = np.array([r[0] for r in rows])[val]
    order = lambda seed: np.lexsort((keys, (keys * 7919 + seed * 104729) % 1_000_003))
    v = zz[val]
    falls = []
    for i in range(2):
        donor = np.empty(len(keys), int)
        donor[order(0)] = order(i + 1)
        m = v.copy()
        m[:, 0] = v[donor, 0]
        falls.append(auroc(v @ b, y[val]) - auroc(m @ b, y[val]))
    assert got["x"] == pytest.approx(np.mean(falls), abs=1e-9)
