from collections import Counter

import numpy as np
import xxhash

from evenkeel.llm.queries import op10_simhash, read
from evenkeel.llm.simhash import components, fingerprint, link_group, near_duplicates, near_edges


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(fps, names):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, n in enumerate(names):
        least[find(i)] = min(least.get(find(i), n), n)
    return [least[find(i)] for i in range(len(fps))]


def test_query(spark, sf):
    docs = read(spark, sf, "documents").collect()
    fps = [brute_fp(r.text) for r in docs]
    want = sorted((r.doc_id, f"{f:016x}", c) for r, f, c in zip(docs, fps, brute_roots(fps, [r.doc_id for r in docs]), strict=True))
    assert sorted(map(tuple, op10_simhash(spark, sf).collect())) == want


def clusters(rng, n, size):
    out = set()
    for c in rng.integers(0, 2**63, n, dtype=np.uint64).tolist():
        x = c
        for _ in range(size):
            out.add(x)
            for b in rng.integers(0, 64, rng.integers(1, 5)).tolist():
                x ^= 1 << b
    return sorted(out)


def test_edges_keep_every_component(spark):
    fps = clusters(np.random.default_rng(3), 12, 25)
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    want = brute_roots(fps, signed)
    for chunk in (4096, 4):
        roots = {r.node: r.root for r in components(near_edges(df, chunk=chunk)).collect()}
        assert [roots.get(s, s) for s in signed] == want
    star = dict(link_group(np.array(signed, np.int64)))
    assert [star.get(s, s) for s in signed] == want


def test_references_discard_pairs_that_share_a_block():
    rng, tally = np.random.default_rng(5), Counter()
    # 26 bits in common, as in a group, and the others at random but for some copies
    group = rng.integers(0, 2**63, 2000, dtype=np.uint64) & ~np.uint64((1 << 26) - 1)
    group = np.unique(np.concatenate([group, group[:50] ^ np.uint64(1 << 40)]))
    edges = link_group(group.view(np.int64), 3, tally)
    near = np.argwhere(np.triu(np.bitwise_count(group[:, None] ^ group[None, :]) <= 3, 1))
    assert set(edges) == {(int(group[j]), int(group[i])) for i, j in near} and len(edges) >= 50
    assert tally["pairs"] == len(group) * (len(group) - 1) // 2
    assert tally["verified"] < tally["open"] / 20  # what the other 31 coordinates leave
    assert tally["open"] <= tally["first"] < tally["pairs"] and tally["linked"] == len(edges)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 90, 90: 90}


def test_edges(odd, none):
    got = near_duplicates(odd).collect()
    rows = odd.collect()
    assert sorted((r.doc_id or -1, r.fp % 2**64) for r in got) == sorted((r.doc_id or -1, brute_fp(r.text)) for r in rows)
    by_id = {r.doc_id: r.component_id for r in got if r.doc_id}
    assert by_id[3] == by_id[1] == 1 and by_id[5] == by_id[6] == by_id[4] == 4
    assert near_duplicates(none).collect() == []
    assert fingerprint("a b") == xxhash.xxh64_intdigest("a b", 42)
    assert fingerprint("w " * 50, step=7) == fingerprint("w " * 50)
