"""Each row of a null or repeated id has its own decision and columns, in every stage."""

from collections import Counter

import corpus_pipeline as P

from evenkeel.llm.queries import read


def rows(df):
    return Counter((r.doc_id, r.text, r.lang, r.source) for r in df.collect())


def test_rows_keep_their_own_decision(spark, sf, odd):
    item = read(spark, sf, "benchmark").orderBy("item_id").first().text
    a, b, c, d = (" ".join(f"{w}{i}" for i in range(30)) for w in ("alpha", "beta", "gamma", "delta"))
    data = [
        (None, a, "en", "s1"), (None, b, "de", "s2"), (None, "12 34", None, "s3"), (1, c, "en", "s4"), (1, "5 ...", "de", "s5"),
        (1, f"words before {item} {item}", "fr", "s6"), (None, f"{d} {item}", "fr", "s7"), (2, None, "en", "s8"), (3, a, "es", "s9"),
    ]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in data], "doc_id long, text string, lang string, source string, n_chars long")

    def want(*sources):
        return Counter(r for r in data if r[3] in sources)

    assert rows(P.language_id(spark, docs, sf)) == want("s1", "s2", "s4", "s6", "s7", "s9")
    # the line of s9 is that of s1, whose null id is the smallest: s9 had text and has none left
    assert rows(P.line_dedup_stage(spark, docs, sf)) == want(*(f"s{i}" for i in range(1, 8))) + Counter([(2, "", "en", "s8")])
    assert rows(P.simhash_stage(spark, docs, sf)) == want(*(f"s{i}" for i in range(2, 10)))
    assert rows(P.decontaminate_stage(spark, docs, sf)) == want("s1", "s2", "s3", "s4", "s5", "s8", "s9")
    step = docs
    for _, stage in P.STAGES:
        step = stage(spark, step, sf)
    assert Counter((r.doc_id, r.text) for r in step.collect()) == Counter([(None, a), (None, b), (1, c)])

    repeated = spark.createDataFrame([(1, a, "en", "x", 1), (2, f"{a}\n\t\x0b\n{a}\r\n ", "en", "x", 1)], docs.schema)
    assert [r.doc_id for r in P.line_dedup_stage(spark, repeated, sf).collect()] == [1]  # nothing but blanks is left of 2

    got = rows(P.language_id(spark, odd, sf))
    assert got == Counter((r.doc_id, r.text, r.lang, r.source) for r in odd.collect() if any(x.isalpha() for x in r.text or ""))
