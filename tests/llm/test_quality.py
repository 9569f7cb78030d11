import math
import re
from collections import Counter

from pyspark.sql import functions as F

from evenkeel.llm.quality import apply_rules, hashes, ngrams, score_documents
from evenkeel.llm.queries import op5_quality, read


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    at = {}
    for i, w in enumerate(windows):
        at.setdefault(w, []).append(i)
    marked = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)}
    failed = len(words) < 20 or 100 * len(marked) > 30 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, dup, len(marked), failed


COLS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in read(spark, sf, "documents").collect()}
    got = op5_quality(spark, sf).collect()
    assert {r.doc_id: tuple(r[c] for c in COLS) for r in got} == {i: brute(t) for i, t in texts.items()}
    labels = {r.doc_id: r.quality for r in read(spark, sf, "labels").collect()}
    ok = [r for r in got if labels.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r for r in got if labels.get(r.doc_id) == 0 and not r.base_failed]
    assert sum(r.kept for r in ok) >= 0.98 * len(ok)
    assert sum(r.kept for r in bad) <= 0.5 * len(bad)
    assert all(r.kept == (not r.base_failed) for r in got if r.n_words < 20)


def test_edges(spark, odd, none):
    good = odd.select("doc_id")
    got = apply_rules(score_documents(odd, good)).collect()
    want = sorted(map(str, ((r.doc_id, *brute(r.text)) for r in odd.collect())))
    assert sorted(str((r.doc_id, *(r[c] for c in COLS))) for r in got) == want
    assert score_documents(none, good).collect() == []
    blind = apply_rules(score_documents(odd, good.limit(0)))
    assert blind.filter((F.col("kept") != ~F.col("base_failed"))).isEmpty()


def test_score_is_the_mean_log_ratio(spark):
    texts = ["a b a c", "b b", "c d e a", None, "", "\n", "x y z a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    held = docs.filter("pmod(xxhash64(doc_id, 1), 4) = 0 AND text rlike '[a-z]'")
    good = {r.doc_id for r in docs.filter("doc_id < 3").join(held, "doc_id", "left_anti").collect()}
    rest = {r.doc_id for r in held.collect()}
    assert good and rest
    trusted = docs.filter("doc_id < 3").select("doc_id").unionByName(held.select("doc_id"))
    got = {r.doc_id: r for r in score_documents(docs, trusted, quantile=0.0).collect()}

    def buckets(text):  # by name: neither words nor pairs of these texts share a bucket
        words = (text or "").split()
        return [*words, *zip(words, words[1:], strict=False)]

    names = {n for t in texts for n in buckets(t)}
    one = [ngrams(hashes([w.encode() for w in (n if isinstance(n, tuple) else (n,))]), 18)[-1] for n in names]
    assert len(set(one)) == len(names)
    raw = Counter(n for t in texts for n in buckets(t))
    target = Counter(n for i in good for n in buckets(texts[i]))
    share, room = target.total() / raw.total(), 2**18
    weight = {
        n: math.log((target[n] + share) / (target.total() + room * share)) - math.log((raw[n] + 1) / (raw.total() + room)) for n in names
    }
    for i, t in enumerate(texts):
        want = [weight[n] for n in buckets(t)]
        assert got[i].score is None if not want else abs(got[i].score - sum(want) / len(want)) < 1e-9
        assert abs(got[i].threshold - min(got[j].score for j in rest)) < 1e-12


def test_unseen_is_even_at_any_size(spark):
    many = spark.range(2000).selectExpr("id doc_id", "if(id < 20, 'good words here', concat('junk', id % 50, ' more junk')) text")
    strange = spark.createDataFrame([(-1, "never seen before")], "doc_id long, text string")
    got = score_documents(many.unionByName(strange), many.filter("doc_id < 20"))
    assert got.filter("doc_id = -1").first().score < 0 < got.filter("doc_id = 1").first().score


def test_very_long_text(spark):
    docs = spark.range(1).selectExpr("id doc_id", "concat(repeat('one two three four five six seven eight nine ', 500000), 'end') text")
    row = apply_rules(score_documents(docs, docs)).first()
    assert (row.n_words, row.n_repeat_words, row.kept) == (4_500_001, 4_500_000, False)


def test_every_trusted_document_counts(spark):
    """Of 24,000 trusted documents with a word each of their own, all that are not held back raise their word."""
    good = spark.range(24_000).selectExpr("id AS doc_id", "concat('w', id) AS text")
    docs = good.unionByName(spark.range(24_000, 48_000).selectExpr("id AS doc_id", "concat('u', id) AS text"))
    got = score_documents(docs, good.select("doc_id"), quantile=0.5)
    counted = got.filter("doc_id < 24000 AND pmod(xxhash64(doc_id, 1), 4) <> 0")
    # in a few buckets several words meet
    assert counted.filter("score > 0").count() >= 0.97 * counted.count()
    held = sorted(r.score for r in got.filter("doc_id < 24000 AND pmod(xxhash64(doc_id, 1), 4) = 0").collect())
    middle = (held[(len(held) - 1) // 2] + held[len(held) // 2]) / 2
    assert abs(got.first().threshold - middle) < 1e-12
