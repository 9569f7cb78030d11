import math
import re
from collections import Counter

import numpy as np
import pytest

from evenkeel.llm import lexical as module
from evenkeel.llm.lexical import Lists, search, terms
from evenkeel.llm.queries import op13_lexical_search, read

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=50):
    """Every document scored for every item."""
    held = [(d, Counter(terms_of(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    docs_n, terms_n = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in held:
            m = 100 - 50 + (50 * n * docs_n) // terms_n
            s = sum(math.floor(1000 * math.log((2 * docs_n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms_of(text)) if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:top])]
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def pairs(df, key):
    return [(r[key], r["text"]) for r in df.collect()]


def test_query(spark, sf, monkeypatch):
    docs, items = (pairs(read(spark, sf, t), k) for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    want = brute(docs, items)
    assert found(op13_lexical_search(spark, sf)) == want
    # more passes and smaller shards change nothing
    monkeypatch.setattr(module, "PASS_TERMS", 300)
    assert found(op13_lexical_search(spark, sf)) == want


@pytest.mark.parametrize("top", [1, 3, 50])
def test_odd_rows(spark, odd, none, top):
    """Nulls, ties, copies, rows without an id, items without a term."""
    items = [(1, "the LAZY dog"), (1, "the LAZY dog"), (None, "line"), (2, None), (3, ""), (4, "... !"), (5, "zzz unknown"), (6, "é ünïcode 日本語 a line"), (7, "word1 of the a " * 3)]
    asked = spark.createDataFrame([(*i, "x", "y") for i in items], "item_id long, text string, doc_id string, score string")
    assert found(search(odd.repartition(4), asked, top)) == brute(pairs(odd, "doc_id"), items, top)
    assert search(none, asked, top).collect() == []
    empty = search(odd, asked.limit(0), top)
    assert empty.collect() == [] and empty.columns == ["item_id", "rank", "doc_id", "score"]


def test_many_copies(spark):
    docs = [(i, "common words here") for i in range(300, 0, -1)] + [(i, f"common word{i} other") for i in range(301, 400)]
    items = [(0, "common words"), (1, "common word350 other")]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert found(search(table, spark.createDataFrame(items, "item_id long, text string"))) == brute(docs, items)


def test_reading_stops_early_and_is_exact():
    rng = np.random.default_rng(1)
    for trial in range(30):
        rows, lists = 2000, 12
        code, row = np.nonzero(rng.random((lists, rows)) < rng.random((lists, 1)) ** 3)
        impact = rng.choice([rng.integers(1, 4, len(code)), (rng.pareto(1, len(code)) * 100).astype(np.int64)])
        index = Lists(row, code, impact, lists, rows)
        codes = rng.choice(lists, 5, replace=False)
        score = np.zeros(rows, np.int64)
        for c, r, x in zip(code, row, impact, strict=True):
            score[r] += x if c in codes else 0
        for top in (1, 10, 3000):
            r, s = index.best(codes, top)
            floor = max(1, np.sort(score)[-top]) if top <= rows else 1
            assert dict(zip(r.tolist(), s.tolist(), strict=True)) == {i: v for i, v in enumerate(score.tolist()) if v >= floor}, trial


def test_terms_of_a_very_long_text():
    text = "Alpha,beta;Ünder_9 " * 1_200_000 + "x" * 5_000_000
    assert len(text) > 20_000_000
    held = Counter()
    for words in terms(text):
        held.update(words)
    assert held == {b"alpha": 1_200_000, b"beta": 1_200_000, "Ünder".encode(): 1_200_000, b"9": 1_200_000, b"x" * 5_000_000: 1}
