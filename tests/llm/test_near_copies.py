from itertools import combinations

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from evenkeel.llm import near_copies
from evenkeel.llm.near_copies import LEAST, MOST, components, fingerprint, one_of_each, possible_edges, prefix, shingle_set, sure_edges, uncrowded, with_sets
from evenkeel.llm.queries import read


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_groups(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            root = [root[i] if r == root[j] else r for r in root]
    return root


def edited(text, every, rng):
    """The text with a word changed about each ``every`` words."""
    w = text.split()
    for i in range(int(rng.integers(0, every)), len(w), every):
        w[i] = f"changed{i}"
    return " ".join(w)


def planted(spark, sf):
    rng = np.random.default_rng(5)
    docs = read(spark, sf, "documents").filter("length(text) between 600 and 6000").dropDuplicates(["text"]).orderBy("doc_id").limit(30).collect()
    rows = [(r.doc_id, r.text) for r in docs]
    for r in docs:
        for k, every in enumerate((48, 65, 100, 180)):
            t = edited(r.text, every, rng)
            if 0.8 <= jaccard(shingles(t), shingles(r.text)) <= 0.95:
                rows.append((10_000 * (k + 1) + r.doc_id, t))
    return rows


def test_edited_copies_go(spark, sf):
    """Copies of Jaccard 0.8 to 0.95 go; the rows kept are those of brute force (recall 1)."""
    rows = planted(spark, sf)
    assert len(rows) > 60
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.simhash_stage(spark, df, sf).collect()}
    least = {}
    for (i, _), g in zip(rows, brute_groups([t for _, t in rows]), strict=True):
        least[g] = min(i, least.get(g, i))
    assert kept == set(least.values()) and not any(i >= 10_000 for i in kept)


def test_large_groups_are_dealt_out(spark, sf):
    rows = planted(spark, sf)
    sets = with_sets(spark.createDataFrame(rows, "doc_id long, text string")).dropDuplicates(["_set"]).cache()
    wide = components(possible_edges(sets, chunk=2))
    texts = sets.join(wide, F.col("node") == F.col("_set")).select("root", "_set", "text")
    want = {(r.node, r.root) for r in components(sure_edges(texts)).collect()}
    assert want and {(r.node, r.root) for r in components(sure_edges(texts, chunk=2)).collect()} == want


def test_no_near_pair_lacks_a_key():
    rng = np.random.default_rng(1)
    for n in (1, 2, 4, 5, 9, 40, 400):
        for _ in range(50):
            x = np.unique(rng.integers(0, 2**64, n, np.uint64))
            y = np.unique(np.concatenate([x[rng.permutation(n)[: max(1, -(-9 * n // 10))]], rng.integers(0, 2**64, n // 10, np.uint64)]))
            both = len(np.intersect1d(x, y))
            if 5 * both >= 4 * (len(x) + len(y) - both):
                assert np.intersect1d(prefix(x), prefix(y)).size
                for last in (x[::3], y, np.unique(rng.integers(0, 2**64, 5, np.uint64))):
                    assert np.intersect1d(prefix(x, last), prefix(y, last)).size and len(prefix(x, last)) == len(prefix(x))
                assert min(len(x), len(y)) < LEAST or np.bitwise_count(fingerprint(x) ^ fingerprint(y)).sum() <= MOST
    assert len(shingle_set("a b")) == 1 and len(shingle_set("")) == len(shingle_set(None)) == 0
    assert np.array_equal(shingle_set("A b C d E f"), shingle_set("a B c  d e\nF"))


def test_common_shingles_leave_the_prefixes(spark, sf):
    """A passage in all texts is no key where a text has others, and the groups stay those of brute force."""
    common = " ".join(f"boilerplate{i}" for i in range(60))
    rng = np.random.default_rng(3)
    rows = [(i, f"{common} " + " ".join(rng.choice([f"w{k}" for k in range(3000)], 200))) for i in range(40)]
    rows += [(100 + i, edited(t, 90, rng)) for i, t in rows[:10]] + [(200 + i, common + f" {i}") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = with_sets(df).withColumn("_row", F.col("doc_id")).cache()
    before = made.select(F.explode("_prefix").alias("k")).groupBy("k").count().agg(F.max("count")).first()[0]
    sets = uncrowded(made.drop("doc_id", "text"), df.withColumnRenamed("doc_id", "_row"), chunk=15).cache()
    after = sets.filter("_row < 200").select(F.explode("_prefix").alias("k")).groupBy("k").count().agg(F.max("count")).first()[0]
    assert before > 20 and after < 10
    wide = components(possible_edges(sets))
    texts = sets.join(wide, F.col("node") == F.col("_set")).join(df, F.col("doc_id") == F.col("_row")).select("root", "_set", "text")
    root = {r.node: r.root for r in components(sure_edges(texts)).collect()}
    name = {r._row: root.get(r._set, r._set) for r in sets.collect()}
    groups = brute_groups([t for _, t in rows])
    for (i, _), g in zip(rows, groups, strict=True):
        for (j, _), h in zip(rows, groups, strict=True):
            assert (name[i] == name[j]) == (g == h)


def test_very_long_text(spark):
    text = " ".join(f"w{i % 7919}" for i in range(3_600_000))
    assert len(text) > 20_000_000
    kept = one_of_each(spark.createDataFrame([(2, text), (1, text + " x"), (3, "short")], "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [1, 3]


def test_ids(spark, none):
    """Each row has its own decision: a shared or null id neither links rows nor loses them."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (None, c), (None, a), (2, b), (None, c), (3, None), (4, " ")]
    kept = one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted([(1, a), (1, b), (0, c), (3, "")])
    assert one_of_each(none).collect() == []


def test_pivots_discard_before_bits_are_compared():
    rng = np.random.default_rng(5)
    fp = rng.integers(0, 2**64, (40, near_copies.PARTS), np.uint64)
    bits = np.unpackbits(fp.view(np.uint8).reshape(40, -1), axis=1)
    for i in range(20):  # the later half are copies of the first, some bits apart
        flip = rng.choice(bits.shape[1], 4 * i, replace=False)
        bits[20 + i] = bits[i]
        bits[20 + i, flip] ^= 1
    fp = np.packbits(bits, axis=1).view(np.uint64)
    block = np.ascontiguousarray(np.concatenate([np.stack([np.arange(40), np.full(40, 50)], 1), fp.view(np.int64)], 1))
    a, b = (x.ravel() for x in np.meshgrid(np.arange(40), np.arange(40)))
    table = near_copies.pivots(block)
    apart = np.bitwise_count(fp[a] ^ fp[b]).sum(1)
    assert (np.abs(table[a] - table[b]).max(1) <= apart).all()
    assert (near_copies.possible(block, table, a, b) == (apart <= near_copies.MOST)).all()
    # a pair that the table tells apart is discarded, whatever its bits
    table[0, 7] += 200
    got = near_copies.possible(block, table, a, b)
    assert not got[(a == 0) != (b == 0)].any() and got[a == b].all()
