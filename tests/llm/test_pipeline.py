import corpus_pipeline
from pyspark.sql import functions as F

from evenkeel.llm.queries import read


def test_run(spark, sf):
    docs = read(spark, sf, "documents")
    step, sizes = docs, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, sf)
        assert step.columns == docs.columns
        step = corpus_pipeline.materialize(step, "test")
        sizes.append(step.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    last = corpus_pipeline.run(spark, sf).collect()
    texts = {r.doc_id: r.text for r in step.collect()}
    assert {r.doc_id: r.text for r in last} == texts


def test_planted(spark, sf):
    """Copies, leaks, shared lines and texts without a letter are acted on; clean documents stay."""
    docs = read(spark, sf, "documents").filter("length(text) > 400 and lang = 'en'").dropDuplicates(["text"]).orderBy("doc_id").limit(12)
    items = read(spark, sf, "benchmark").orderBy("item_id").limit(1)
    copies = docs.withColumn("doc_id", F.col("doc_id") + 10_000).withColumn("text", F.upper("text"))
    leak = docs.limit(2).crossJoin(items.select(F.col("text").alias("item"))).withColumn("doc_id", F.col("doc_id") + 20_000)
    leak = leak.withColumn("text", F.concat_ws(" ", F.lit("some words before"), "item", "text")).select(docs.columns)
    blank = docs.limit(2).withColumn("doc_id", F.col("doc_id") + 30_000).withColumn("text", F.lit("123 ..."))
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}

    deduped = ids(corpus_pipeline.simhash_stage(spark, docs.unionByName(copies), sf))
    assert not any(i >= 10_000 for i in deduped)
    assert deduped == ids(corpus_pipeline.simhash_stage(spark, docs, sf))
    clean = ids(corpus_pipeline.decontaminate_stage(spark, docs, sf))
    assert ids(corpus_pipeline.decontaminate_stage(spark, docs.unionByName(leak), sf)) == clean
    assert ids(corpus_pipeline.language_id(spark, docs.unionByName(blank), sf)) == ids(docs)
    # all lines of a copy are repeated, whatever the case of A-Z; only those under ten characters stay
    lines = corpus_pipeline.line_dedup_stage(spark, docs.unionByName(copies), sf).collect()
    assert {r.doc_id for r in lines} >= ids(docs)
    assert all(len(x.strip()) < 10 for r in lines if r.doc_id >= 10_000 for x in r.text.split("\n"))


def test_edges(spark, sf, odd, none):
    for docs in (odd, none):
        step = docs
        for _, stage in corpus_pipeline.STAGES:
            step = stage(spark, step, sf)
        out = step.collect()
        assert len({r.doc_id for r in out}) == len(out) <= docs.count()
