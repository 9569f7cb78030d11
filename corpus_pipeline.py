"""Corpus pipeline: documents through five of the operators, each stage on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm.decontaminate import contained_items
from evenkeel.llm.language_id import UNDETERMINED, detect_languages
from evenkeel.llm.line_dedup import BLANKS, line_dedup
from evenkeel.llm.near_copies import one_of_each, without
from evenkeel.llm.queries import read, tokenizer_file
from evenkeel.llm.scratch import materialize
from evenkeel.llm.sentencepiece_codec import decode_documents, encode_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose language cannot be determined: null text, or text without a letter.  Ids decide nothing:
    a row of a null or repeated id has its own verdict."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    # under other names, as the result has columns of its own
    found = detect_languages(docs.withColumns({f"_row_{c}": F.col(c) for c in rest}), keep=["text", *(f"_row_{c}" for c in rest)])
    found = found.filter(F.col("lang_pred") != UNDETERMINED)
    return found.select(*[c if c in ("doc_id", "text") else F.col(f"_row_{c}").alias(c) for c in docs.columns])


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their repeated lines; a row that had text and has none left goes.  Each row keeps its own other
    columns.  Rows of one id are one document, whose lines do not repeat each other; so are the rows of a null id,
    which counts as the smallest."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = line_dedup(docs.withColumns({f"_row_{c}": F.col(c) for c in rest}), keep=[f"_row_{c}" for c in rest])
    found = found.filter((F.col("n_dropped") == 0) | (F.btrim("text", F.lit(BLANKS)) != ""))
    out = found.select(*[c if c in ("doc_id", "text") else F.col(f"_row_{c}").alias(c) for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word Jaccard 0.8 or more) stays, whatever the ids: that of the
    smallest id, a null id being the largest.  Rows that share an id only, or none, each stay."""
    return one_of_each(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item go.  The text alone decides: rows of a null id are held against the
    items too, and rows that share an id are not one text."""
    keyed = docs.withColumn("_text_key", F.unhex(F.md5("text")))
    found = contained_items(keyed, read(spark, sf_dir, "benchmark"), id_col="_text_key").select("_text_key").distinct()
    return without(keyed, found, "_text_key").select(docs.columns)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_ids, ids, text): the ids of each row's text and the text decoded from them, whatever its doc_id."""
    model = tokenizer_file("piece_bpe_32k.model")
    # written between, so that a task has one Python worker at a time
    back = decode_documents(materialize(encode_documents(docs, model), "ids"), model)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "text")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("simhash", simhash_stage),
    ("decontaminate", decontaminate_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: Fingerprints, mixtures and segmentations are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
