import re

from pyspark.sql import functions as F

from evenkeel.llm.decontaminate import contained_items, decontaminate, sketches
from evenkeel.llm.queries import op2_decontaminate, read


def grams(text, n=5):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}


def parts_of(text):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    return grams(text, min(5, len(words))) if words else set()


def brute(docs, items, t=0.8):
    parts = {i: parts_of(x) for i, x in items}
    out = []
    for d, x in docs:
        g = set().union(*(grams(x, k) for k in range(1, 6)))
        hits = sorted(i for i, p in parts.items() if p and len(p & g) >= t * len(p) - 1e-9)
        out.append((d, len(hits), ",".join(map(str, hits)), bool(hits)))
    return sorted(out, key=str)


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in read(spark, sf, "documents").collect()]
    items = [(r.item_id, r.text) for r in read(spark, sf, "benchmark").collect()]
    want = brute(docs, items)
    assert sum(w[3] for w in want) > 0
    assert sorted(map(tuple, op2_decontaminate(spark, sf).collect()), key=str) == want


def test_threshold_and_edges(spark, odd, none):
    item = " ".join(f"w{i}" for i in range(14))  # ten shingles
    items = spark.createDataFrame(
        [(1, item), (2, "too short"), (3, None), (4, ""), (None, item), (5, item + " " + item)], "item_id long, text string"
    )
    near = {1: item, 2: item.replace("w0 ", "") + " tail", 3: item.replace("w1 ", "x "), 4: item.replace("w7", "x"), 5: ("pad " * 5000) + item.upper()}
    docs = spark.createDataFrame(list(near.items()), "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contained_items(docs, items).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (5, 1)}  # two of ten lost at most
    items = items.unionByName(spark.createDataFrame([(6, "LAZY dog"), (7, "dog lazy"), (8, "テキスト"), (9, "a, b; c!")], items.schema))
    rows = [(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None]
    kept = odd.filter("doc_id is not null")
    want = brute(rows, [(r.item_id, r.text) for r in items.collect() if r.item_id is not None])
    assert {w[2] for w in want} == {"", "6", "8", "9"}
    assert sorted(map(tuple, decontaminate(kept, items).collect()), key=str) == want
    out = decontaminate(odd, items).collect()
    assert len(out) == odd.count() and not any(r.contaminated for r in out if r.doc_id is None)
    assert decontaminate(none, items).collect() == []
    assert not any(r.contaminated for r in decontaminate(odd, items.limit(0)).collect())


def test_very_long_text(spark):
    docs = spark.range(2).selectExpr("id doc_id", "concat(repeat('pad and more ', 1700000), if(id = 1, 'one two three four five six', '')) text")
    items = spark.createDataFrame([(1, "Two three four five, six")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in contained_items(docs, items).collect()] == [(1, 1)]


def test_sketch_holds_one_of_each_contained_set(spark):
    sized = spark.createDataFrame([(i, n, list(range(n))) for i, n in enumerate((1, 2, 9, 10, 31, 100))], "item int, size int, hs array<long>")
    for r in sketches(sized, 0.8).groupBy("item", "size").agg(F.count("*").alias("k")).collect():
        assert r.k > r["size"] * 0.2 - 1e-9 or r.k == r["size"]
        assert r.k >= min(r["size"], int(0.2 * r["size"] + 1e-9) + 1)
