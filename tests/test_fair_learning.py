"""Batch fits, thresholds by group and reductions against second formulations."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.operators import reductions as D
from evenkeel.operators import thresholds as T
from evenkeel.operators.batch_fit import BatchFit, Design, utilities
from evenkeel.operators.transforms import power


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    out = []
    for i in range(400):
        c = "pqr"[int(rng.integers(3))] if i % 17 else None
        x, z = float(rng.normal()), float(rng.normal() * 50)
        y = int(rng.random() < 1 / (1 + np.exp(-(x + 0.01 * z + {"p": 1, "q": -1, "r": 0, None: 0.3}[c]))))
        out.append((i, c, x if i % 23 else None, z, y, "train" if i % 4 < 2 else "val" if i % 4 == 2 else "test", 1.0 + i % 3))
    return out


@pytest.fixture(scope="module")
def parts(spark, rows):
    return spark.createDataFrame(rows, "k int, c string, x double, z double, y int, split string, w double").repartition(3)


STATES = {
    "plain": {}, "cubed": {"x": {"power": 3.0}}, "merged": {"c": {"merge": {"q": "p"}}}, "dropped": {"c": "dropped", "x": "dropped"}, "none": {f: "dropped" for f in "cxz"},
}


def by_hand(rows, state, reg=1e-3, weighted=False):
    """Columns, coefficients and scores of a state, by gradient steps of another kind."""
    cols = []
    for name, at in (("x", 2), ("z", 3)):
        if state.get(name) != "dropped":
            p = state.get(name, {}).get("power", 1.0)
            v = np.array([r[at] or 0.0 for r in rows])
            cols.append(np.sign(v) * np.abs(v) ** p)
    if state.get("c") != "dropped":
        m = state.get("c", {}).get("merge", {})
        c = [m.get(r[1], r[1]) for r in rows]
        cols += [np.array([float(v == level) for v in c]) for level in [*sorted({v for v in c if v}), None]]
    x = np.stack(cols, 1) if cols else np.zeros((len(rows), 0))
    y, split = np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
    w = np.array([r[6] if weighted else 1.0 for r in rows])
    t = split == "train"
    sd = x[t].std(0, ddof=1)
    z = np.column_stack([(x - x[t].mean(0)) / np.where(sd > 0, sd, 1), np.ones(len(rows))])
    b = np.zeros(z.shape[1])
    ridge = np.append(np.full(len(b) - 1, reg), 0)
    for _ in range(200_000):
        p = 1 / (1 + np.exp(-(z[t] @ b)))
        g = z[t].T @ (w[t] * (p - y[t])) / w[t].sum() + ridge * b
        if np.abs(g).max() < 1e-10:
            break
        b -= 1.0 * g
    return 1 / (1 + np.exp(-(z @ b)))


@pytest.mark.parametrize("weighted", [False, True])
def test_batch_fit_equals_single_fits(parts, rows, weighted):
    design = Design(parts, STATES, ["c"], ["x", "z"], ["k", "y", "split", "w"])
    fit = BatchFit(design, "y", "w" if weighted else None)
    assert fit.steps < 15
    got = {(r.candidate, r.k): r.p_event for r in fit.score(design.rows, ["k"]).collect()}
    assert len(got) == len(rows) * len(STATES)
    for name in ("plain", "cubed", "merged", "none"):
        want = by_hand(rows, STATES[name], weighted=weighted)
        assert max(abs(got[name, r[0]] - want[i]) for i, r in enumerate(rows)) < 1e-6, name


def best_ba(y, p):
    cuts = sorted({0.0, 1.0, *[(a + b) / 2 for a, b in zip(sorted(set(p)), sorted(set(p))[1:], strict=False)]})
    return max((np.mean(p[y == 1] >= t) + np.mean(p[y == 0] < t)) / 2 for t in cuts)


def test_utilities_are_balanced_accuracy_at_the_best_threshold(parts, rows):
    found = utilities(parts, STATES, ["c"], ["x", "z"], ["k", "y", "split"], "y")
    val = np.array([r[5] == "val" for r in rows])
    y = np.array([r[4] for r in rows])
    for name, state in STATES.items():
        assert found[name][1] == "VALID" and found[name][0] == pytest.approx(best_ba(y[val], by_hand(rows, state)[val]), abs=1e-9)


def test_utilities_without_two_classes(parts):
    keep = ["k", "y", "split"]
    one = parts.withColumn("y", F.when(F.col("split") == "train", F.lit(1)).otherwise(F.col("y")))
    assert utilities(one, {"a": {}}, ["c"], ["x"], keep, "y") == {"a": (None, "SINGLE_CLASS")}
    assert utilities(parts.filter("split = 'train' or y = 0"), {"a": {}}, ["c"], ["x"], keep, "y") == {"a": (None, "SINGLE_CLASS")}
    with pytest.raises(ValueError, match="more than"):
        Design(parts, {"a": {}}, ["c"], ["x"], keep, most=3)


def test_separable_classes_still_settle(spark):
    frame = spark.createDataFrame([(i, float(i), int(i >= 20), "train" if i % 2 else "val") for i in range(40)], "k int, x double, y int, split string")
    found = utilities(frame, {"a": {}, "b": {"x": {"power": 5.0}}}, [], ["x"], ["k", "y", "split"], "y")
    assert found["a"] == (1.0, "VALID") and found["b"] == (1.0, "VALID")


def groups(spark, n, sizes, seed=0):
    rng = np.random.default_rng(seed)
    data = []
    for g in range(n):
        for _ in range(sizes):
            y = int(rng.random() < 0.3 + 0.1 * g)
            data.append((f"g{g}", y, float(np.round(np.clip(rng.normal(0.4 + 0.05 * g + 0.25 * y * (1 + g % 2), 0.2), 0, 1), 2))))
    return data, spark.createDataFrame(data, "a string, y int, s double")


@pytest.mark.parametrize(("n", "objective"), [(2, "accuracy"), (4, "accuracy"), (4, "ba")])
def test_group_thresholds_equal_all_products(spark, n, objective):
    data, df = groups(spark, n, 60)
    grid = [0.0, 0.2, 0.35, 0.5, 0.65, 0.8, 1.01]
    points = {}
    for g in sorted({r[0] for r in data}):
        own = [r for r in data if r[0] == g]
        pos, neg = [s for _, y, s in own if y], [s for _, y, s in own if not y]
        points[g] = [(t, sum(s >= t for s in pos), sum(s >= t for s in neg), len(pos), len(neg)) for t in grid]
    for bound in (0.01, 0.08, 0.3, 1.0):
        best = None
        for choice in product(*points.values()):
            tpr, fpr = [tp / p for _, tp, _, p, _ in choice], [fp / q for _, _, fp, _, q in choice]
            if max(max(tpr) - min(tpr), max(fpr) - min(fpr)) > bound + 1e-12:
                continue
            tp, fp, p, q = (sum(c[i] for c in choice) for i in (1, 2, 3, 4))
            value = (tp + q - fp) / (p + q) if objective == "accuracy" else (tp / p + 1 - fp / q) / 2
            key = (round(value, 12), [-c[0] for c in choice])
            best = max(best, key) if best else key
        got = {r.a: r for r in T.group_threshold_grid(T.threshold_rates(df, "a", "y", "s", grid), "a", bound, objective).collect()}
        assert [got[g].t for g in points] == [-t for t in best[1]]
        assert all(r[objective] == pytest.approx(best[0]) and r.eo <= bound + 1e-9 for r in got.values())


def test_group_without_an_outcome_is_an_error(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.5), ("b", 1, 0.2)], "a string, y int, s double")
    with pytest.raises(ValueError, match="both outcomes"):
        T.group_threshold_grid(T.threshold_rates(df, "a", "y", "s", [0.0, 0.5]), "a", 1.0)
    with pytest.raises(ValueError, match="both outcomes"):
        T.group_threshold_eo(df, "a", "y", "s")


def hull_height(own, x):
    """The highest TPR of mixtures of two thresholds at FPR x."""
    pos, neg = [s for _, y, s in own if y], [s for _, y, s in own if not y]
    pts = [(sum(s >= t for s in neg) / len(neg), sum(s >= t for s in pos) / len(pos)) for t in [*sorted({s for *_, s in own}), 2.0]]
    best = 0.0
    for a in pts:
        for b in pts:
            if a[0] <= x <= b[0]:
                best = max(best, a[1] if a[0] == b[0] else a[1] + (x - a[0]) / (b[0] - a[0]) * (b[1] - a[1]))
    return best


@pytest.mark.parametrize("n", [1, 2, 4])
def test_mixtures_meet_in_the_best_common_point(spark, n):
    data, df = groups(spark, n, 80, seed=n)
    policy = T.group_threshold_eo(df.repartition(4), "a", "y", "s")
    rows = policy.collect()
    assert len(rows) == n and len({(round(r.fpr, 12), round(r.tpr, 12)) for r in rows}) == 1
    decided = T.group_decision(df, policy, "a", "s")
    reached = decided.groupBy("a", "y").agg(F.avg("q_decision").alias("q"), F.min("q_decision").alias("lo"), F.max("q_decision").alias("hi")).collect()
    for r in reached:
        assert r.q == pytest.approx(rows[0].tpr if r.y else rows[0].fpr, abs=1e-9) and r.lo >= 0 and r.hi <= 1
    by_group = {g: [r for r in data if r[0] == g] for g in {r[0] for r in data}}
    top = max(min(hull_height(own, x) for own in by_group.values()) - x for x in np.linspace(0, 1, 101))
    assert rows[0].tpr - rows[0].fpr >= top - 1e-9
    assert min(hull_height(own, rows[0].fpr) for own in by_group.values()) == pytest.approx(rows[0].tpr, abs=1e-9)


def test_policy_of_points_that_differ(spark):
    """Two groups whose only inner points are (.2, .9) and (.2, .5)."""
    def group(g, tpr):
        return [(g, 1, 0.8)] * int(10 * tpr) + [(g, 1, 0.1)] * (10 - int(10 * tpr)) + [(g, 0, 0.8)] * 2 + [(g, 0, 0.1)] * 8

    df = spark.createDataFrame(group("m", 0.9) + group("f", 0.5), "a string, y int, s double")
    policy = T.group_threshold_eo(df, "a", "y", "s")
    reached = {(r.a, r.y): r.q for r in T.group_decision(df, policy, "a", "s").groupBy("a", "y").agg(F.avg("q_decision").alias("q")).collect()}
    assert reached["m", 1] == pytest.approx(0.5) == reached["f", 1] and reached["m", 0] == pytest.approx(0.2) == reached["f", 0]


def test_linear_program_against_vertices():
    rng = np.random.default_rng(0)
    for _ in range(60):
        m, n = 3, 6
        a = rng.normal(size=(m, n))
        b = a @ rng.random(n)
        cost = rng.random(n)
        x = D.linear_program(cost, a, b)
        assert (x >= -1e-9).all() and np.allclose(a @ x, b)
        best = np.inf
        for pick in product([0, 1], repeat=n):
            on = [i for i in range(n) if pick[i]]
            if len(on) == m and abs(np.linalg.det(a[:, on])) > 1e-9:
                v = np.linalg.solve(a[:, on], b)
                if (v >= -1e-9).all():
                    best = min(best, cost[on] @ v)
        assert cost @ x == pytest.approx(best, abs=1e-7)
    with pytest.raises(ValueError, match="no solution"):
        D.linear_program(np.ones(2), np.ones((1, 2)), np.array([-1.0]))


@pytest.mark.parametrize("constraint", ["eo", "dp"])
def test_reduction_keeps_its_bound_on_rows(spark, constraint):
    rng = np.random.default_rng(2)
    data = []
    for i in range(900):
        g = i % 3
        y = int(rng.random() < (0.3, 0.5, 0.6)[g])
        data.append((i, "abc"[g] if i else None, float(rng.normal() + y + 0.8 * g), float(rng.normal() + 0.5 * y), y))
    df = spark.createDataFrame(data, "k int, a string, x double, z double, y int")
    game = D.ExponentiatedGradient(df, ["x", "z"], "y", "a", constraint=constraint, eps=0.03, rounds=5, gap=0.01)
    w = game.mix.weights
    assert w.sum() == pytest.approx(1) and (w >= 0).all() and len(w) == len(game.mix.deciders)
    assert game.mix.gaps[-1] < game.mix.gaps[0]
    q = df.withColumn("q", game.mix.decision(["x", "z"])).filter("a is not null")
    keys = ["y"] if constraint == "eo" else []
    rate = {tuple(r[:-1]): r.q for r in q.groupBy("a", *keys).agg(F.avg("q").alias("q")).collect()}
    every = {tuple(r[:-1]): r.q for r in q.groupBy(*keys).agg(F.avg("q").alias("q")).collect()}
    assert max(abs(v - every[k[1:]]) for k, v in rate.items()) <= 0.03 + 1e-9
    wrong = q.agg(F.avg(F.when(F.col("y") == 1, 1 - F.col("q")).otherwise(F.col("q")))).first()[0]
    assert wrong == pytest.approx(sum(x * e for x, (e, _) in zip(w, game.tried, strict=True)))
    assert wrong < min(game.tried[0][0], game.tried[1][0]) - 0.02  # better than a constant decision


def test_power_of_a_null_feature_counts_as_zero(spark):
    assert spark.range(1).select(F.coalesce(power(F.lit(None).cast("double"), 3.0), F.lit(0.0))).first()[0] == 0.0
