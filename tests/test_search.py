"""The mitigation search on small frames of known geometry."""

import json

import pytest
from pyspark.sql import functions as F

from evenkeel.operators import search as S


@pytest.fixture(scope="module")
def frame(spark):
    """c separates the groups and tells y; u is even; x separates them by its tail."""
    rows = []
    for i in range(400):
        a = "m" if i % 2 else "f"
        c = "pq"[i % 2] if i % 5 else "rs"[i % 2]
        x = float(i % 40) + (60.0 if a == "m" and i % 7 == 0 else 0.0)
        rows.append((i, a, c, "uv"[(i // 2) % 2], x, int((i // 4) % 2 == 0), "pr"[(i // 4) % 2]))
    return spark.createDataFrame(rows, "k int, a string, c string, u string, x double, y int, t string").cache()


def chain_by_hand(rows, start=()):
    """Merges of (group, category) rows by widest share gap, down to one category."""
    rows = [(g, dict(start).get(c, c)) for g, c in rows]
    out = []
    while len(cats := sorted({c for _, c in rows})) > 1:
        share = {(g, c): sum(r == (g, c) for r in rows) / sum(r[0] == g for r in rows) for g in {g for g, _ in rows} for c in cats}
        groups = sorted({g for g, _ in rows})
        gaps = []
        for i, ga in enumerate(groups):
            for gb in groups[i + 1 :]:
                diff = {c: round(share[gb, c] - share[ga, c], 12) for c in cats}
                src = min(cats, key=lambda c: (-diff[c], c))
                dst = min(reversed(cats), key=lambda c: diff[c])
                gaps.append((-abs(diff[src] - diff[dst]), ga, gb, src, dst))
        *_, src, dst = min(gaps)
        rows = [(g, dst if c == src else c) for g, c in rows]
        out.append((src, dst))
    return out


def test_chain_equals_merging_by_hand(frame):
    cell = S.G.cells(frame, ["a"], ["c"])
    got = S.merge_chain(cell, "c", "a")
    want, mapping = [], {}
    for src, dst in chain_by_hand([(r.a, r.c) for r in frame.collect()]):
        mapping = S.compose(mapping, src, dst)
        want.append((mapping, 3 - len(want)))
    assert got == want
    again = S.merge_chain(cell, "c", "a", got[0][0])
    assert again == got[1:]


def test_full_mapping_is_kept_and_reaches_epsilon(frame):
    m = S.Mitigation(frame, ["a"], ["c", "u"], [], "y", [], epsilon=0.05, phi=1.0)
    state = m.run()
    assert m.status == "CONVERGED" and set(state) == {"c"}
    change = json.loads(m.trace[0][4])
    assert state["c"] == change
    from evenkeel.operators.transforms import apply_state

    mapped = apply_state(frame.select("k", "a", "c", "u", "y"), state, ["k", "a", "y"])
    cats = ["u"] if change == "dropped" else ["c", "u"]
    redo = S.Mitigation(mapped, ["a"], cats, [], "y", [], epsilon=0.05)
    assert all(d < 0.05 for d, *_ in redo.ranking())
    after = {f: d for d, _, f in m.ranking()}
    assert all(abs(after[f] - d) < 1e-9 for d, _, f in redo.ranking())


def test_information_gate_rejects(frame):
    # t tells y fully and is even between groups; told apart by a copy of y as the attribute, no merge may lose it
    m = S.Mitigation(frame.withColumn("b", F.col("t")), ["b"], ["t"], [], "y", [], epsilon=0.01, phi=0.2)
    assert m.run() == {} and m.status == "EXHAUSTED"
    assert [r[-1] for r in m.trace] == ["FAILED"]
    free = S.Mitigation(frame.withColumn("b", F.col("t")), ["b"], ["t"], [], "y", [], epsilon=0.01, phi=1.0)
    assert free.run() == {"t": "dropped"} and free.status == "CONVERGED"


def test_stop_and_next(frame):
    b = frame.withColumn("b", F.col("t")).select("b", "t", "y", F.when(F.col("k") % 10 == 0, F.lit("z")).otherwise(F.when(F.col("t") == "p", F.lit("w")).otherwise("v")).alias("e"))
    kw = {"epsilon": 0.05, "phi": 0.3}
    stop = S.Mitigation(b, ["b"], ["t", "e"], [], "y", [], mode="stop", **kw)
    stop.run()
    assert stop.status == "EXHAUSTED" and len(stop.trace) == 1
    both = S.Mitigation(b, ["b"], ["t", "e"], [], "y", [], mode="next", **kw)
    both.run()
    assert both.status == "EXHAUSTED" and {r[2] for r in both.trace} == {"t", "e"}


def test_powers_cursor_overflow_and_cycle(frame):
    powers = [3.0, 1 / 3, 5.0, 1 / 5]
    start = S.Mitigation(frame, ["a"], ["u"], ["x"], "y", powers).ranking()[0]
    m = S.Mitigation(frame, ["a"], ["u"], ["x"], "y", powers, epsilon=0.95 * start[0], phi=1.0)
    assert start[2] == "x" and 0 < m.ranking()[0][0] == start[0]
    m.run()
    tried = m.at["x"]
    power = m.state["x"]["power"]
    assert m.powers[tried - 1] == power and m.status in ("CONVERGED", "EXHAUSTED")
    by_hand = []
    for p in m.powers[:tried]:
        rows = [(r.a, r.x**p) for r in frame.collect()]
        mean = {g: sum(x for a, x in rows if a == g) / sum(a == g for a, _ in rows) for g in "fm"}
        by_hand.append(abs(mean["f"] - mean["m"]) / (max(x for _, x in rows) - min(x for _, x in rows)))
    g = S.power_moments(frame, ["a"], "x", m.powers[:tried])
    got = {int(r.feature): r.g for r in S.G.div_num(g).collect()}
    assert all(abs(got[i] - v) < 1e-9 for i, v in enumerate(by_hand))
    # the next search begins after the power that was taken
    assert m._search("x", "a") is None or m.at["x"] > tried
    huge = S.Mitigation(frame.withColumn("x", F.col("x") * 1e20 + 1), ["a"], ["u"], ["x"], "y", [3.0], epsilon=1e-4, phi=1.0)
    assert huge.run()["x"] == "dropped"
    kept = S.Mitigation(frame.withColumn("x", F.col("x") * 1e20 + 1), ["a"], ["u"], ["x"], "y", [3.0], epsilon=1e-4, phi=0.5)
    assert "x" not in kept.run() and kept.status == "EXHAUSTED"


def test_cycle_ends_the_search(frame):
    m = S.Mitigation(frame, ["a"], ["u"], ["x"], "y", [3.0, 5.0], epsilon=1e-6, cursor="restart")
    calls = iter([({"power": 3.0}, 0.5, m.g["x"]), ({"power": 5.0}, 0.5, m.g["x"]), ({"power": 3.0}, 0.5, m.g["x"])])
    m._search = lambda f, a: next(calls)
    assert m.run() == {"x": {"power": 5.0}} and m.status == "CYCLE" and len(m.trace) == 3


def test_measure_by_embedding(frame):
    m = S.Mitigation(frame, ["a"], ["c", "u"], ["x"], "y", [3.0], epsilon=0.05, phi=1.0, measure="dphi", mode="next")
    m.run()
    assert m.trace and all(r[6] < 0.05 for r in m.trace if r[-1] == "ACCEPTED")
    with pytest.raises(ValueError):
        S.Mitigation(frame, ["a"], ["c"], [], "y", [], mode="other")


def parts(frame):
    split = F.when(F.col("k") % 5 < 3, "train").when(F.col("k") % 5 == 3, "val").otherwise("test")
    return frame.select("k", "y", "a", "c", "u", "x", split.alias("split"))


def test_merged_categories_reach_the_model(spark, frame):
    from evenkeel.operators import study as Y

    p = parts(frame.withColumn("c", F.concat("t", "c")))
    keep = ["k", "y", "a", "split"]
    plain = Y.validation_utility(p, {}, ["c"], [], keep, "y")
    merged = Y.validation_utility(p, {"c": {"merge": {v: "one" for v in ("pp", "pq", "pr", "ps", "rp", "rq", "rr", "rs")}}}, ["c"], [], keep, "y")
    assert plain > 0.99 and abs(merged - 0.5) < 1e-9
    assert abs(Y.validation_utility(p, {"c": "dropped"}, ["c"], [], keep, "y") - 0.5) < 1e-9


def test_one_hot_levels(spark):
    from evenkeel.operators import study as Y

    fit = spark.createDataFrame([("a",), ("b",)], "c string")
    out, names = Y.one_hot(spark.createDataFrame([("a",), ("b",), (None,), ("z",)], "c string"), fit, ["c"])
    got = {r.c: [r[n] for n in names] for r in out.collect()}
    assert all(sum(v) == 1 for v in got.values()) and len({tuple(v) for v in got.values()}) == 4
    with pytest.raises(ValueError):
        Y.one_hot(fit, fit, ["c"], most=2)


def test_enhancement_rejects_what_does_not_gain(frame):
    from evenkeel.operators import study as Y

    p = parts(frame)
    m = S.Mitigation(p.filter("split = 'train'"), ["a"], ["u"], ["x"], "y", [3.0], epsilon=10.0)
    rows, best = Y.enhance_step(p, m, ["u"], ["x"], ["k", "y", "a", "split"], "y", [3.0])
    assert {r[0] for r in rows} == {"u", "x"}
    for r in rows:
        assert (r[5] == "accepted") == (best is not None and r[0] == best[0] and r[4] == max(q[4] for q in rows if q[4] is not None and q[5] != "no gain"))
        assert r[5] != "no gain" or r[4] < 1e-6
    tight = S.Mitigation(p.filter("split = 'train'"), ["a"], ["u"], ["x"], "y", [3.0], epsilon=-1.0)
    rows, best = Y.enhance_step(p, tight, ["u"], ["x"], ["k", "y", "a", "split"], "y", [3.0])
    assert best is None and {r[5] for r in rows} <= {"over epsilon and slack", "not valid"}
    assert not any(r[3] for r in rows)  # what is not feasible is not fitted


def test_origin_distances_are_those_of_the_geometry(frame):
    m = S.Mitigation(frame, ["a", "t"], ["c", "u"], ["x"], "y", [3.0])
    rows = [(0, at, x, y, f, v) for f, pairs in m.g.items() for at, x, y, v in pairs]
    g = frame.sparkSession.createDataFrame(rows, "cand int, attr string, grp_a string, grp_b string, feature string, g double")
    want = {(r.attr, r.node_a): r.d for r in S.G.distances(g, ["cand", "attr"]).filter("node_b = 'origin'").collect()}
    got = S.origin_distances(m.g)
    assert want.keys() == got.keys() and all(abs(want[k] - got[k]) < 1e-12 for k in want)
