"""Quality rules: base counts and a hashed n-gram log-likelihood ratio.

Words and word pairs hash into ``2**bits`` buckets.  One multinomial is counted over the trusted documents, one
over all documents.  A document's score is the mean log ratio of its n-grams.  Every trusted document is used: three
quarters, by hash of the id, are counted, and the threshold is a fixed quantile of the scores of all others, as
these are like those of any other document as good.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..sources.package import ship
from .ragged import slices
from .scratch import materialize

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Trusted ids that may be broadcast; with more of them, documents are joined by id.
BROADCAST_IDS = 4_000_000


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def ngrams(h: np.ndarray, bits: int, lens: np.ndarray | None = None) -> np.ndarray:
    """Buckets of the words and of the pairs of neighbours; of texts of ``lens`` words, in no two of them."""
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ h[1:]
    if lens is not None:
        apart = np.cumsum(lens)[:-1] - 1
        pairs = np.delete(pairs, apart[(apart >= 0) & (apart < len(pairs))])
    pairs = (pairs ^ (pairs >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (np.concatenate([h, pairs]) >> np.uint64(64 - bits)).astype(np.int64)


def repeated_words(h: np.ndarray) -> int:
    """Words that lie in an 8-word window found twice or more."""
    if len(h) <= WINDOW:
        return 0
    n = len(h) - WINDOW + 1
    w = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        w = w * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(h) + 1, np.int64)
    at = np.flatnonzero(twice)
    edge[at] += 1
    np.subtract.at(edge, at + WINDOW, 1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif line.strip(" \t\n\x0b\x0c\r"):
            seen.add(line)
    return n


def score_documents(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bits: int = 18,
    quantile: float = 0.002,
    smoothing: float = 1.0,
) -> DataFrame:
    """One row per input row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, threshold.

    ``trusted`` is a table of ids, all of which are learned from.  The raw counts are over all documents.  Null or empty text has no words, counts of 0 and
    score null, and a null id is never trusted.  A bucket's weight is the log of its share in the target
    over its share in the raw corpus; raw counts are smoothed by ``smoothing`` and target counts by as much
    in proportion to their total, so that a bucket that neither has is even at every size.  Without a trusted document every score is 0 and the
    threshold null.  Repeated rows are scored each.  Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    ids = trusted.select(F.col(id_col).alias("d")).filter(F.col("d").isNotNull()).distinct()
    # 1: counted, 2: the threshold is taken from these
    ids = materialize(ids.withColumn("trusted", F.when(F.pmod(F.xxhash64("d", F.lit(1)), F.lit(4)) == 0, 2).otherwise(1)), "trusted")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    base = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t")).join(ids, "d", "left")
    base = base.select("d", "t", F.coalesce("trusted", F.lit(0)).alias("trusted"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << bits), np.int64)
        for b in slices(batches, 1):
            good = b.column(2).to_pylist()
            texts = b.column(1).to_pylist()
            for flag in (0, 1):
                words = [t.encode().split() for t, g in zip(texts, good, strict=True) if t and (g == 1) == flag]
                lens = np.fromiter(map(len, words), np.int64, len(words))
                h = hashes([w for doc in words for w in doc])
                sums[flag] += np.bincount(ngrams(h, bits, lens), minlength=1 << bits)
        sums[0] += sums[1]
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (at, *sums[:, at])], ["j", "raw", "target"])

    # a row for each bucket reaches the driver
    table = base.mapInArrow(count, "j long, raw long, target long").groupBy("j").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    known = bool(len(table)) and table.target.sum() > 0
    ratio = np.zeros(1 << bits)
    if known:
        share = table.target.sum() / table.raw.sum()
        raw, target = np.full(1 << bits, smoothing), np.full(1 << bits, smoothing * share)
        raw[table.j.to_numpy()] += table.raw.to_numpy()
        target[table.j.to_numpy()] += table.target.to_numpy()
        ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    model = spark.sparkContext.broadcast(ratio)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        llr = model.value
        for b in slices(batches, 1):
            rows = []
            for t in b.column(1).to_pylist():
                if not t:
                    rows.append((0, 0, 0, 0, 0, None))
                    continue
                words = t.encode().split()
                h = hashes(words)
                blanks = sum(map(t.count, " \t\n\x0b\x0c\r"))
                symbols = sum(map(t.count, SYMBOLS))
                mean = float(llr[ngrams(h, bits)].mean()) if words else None
                rows.append((len(words), len(t) - blanks, symbols, duplicate_lines(t), repeated_words(h), mean))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), *[pa.array(c, pa.int64()) for c in cols[:5]], pa.array(cols[5], pa.float64())],
                ["d", "trusted", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    scored = materialize(base.mapInArrow(score, f"d {kind}, trusted int, {counts}, score double"), "scores")
    threshold = exact_quantiles(scored.filter("trusted = 2"), [], F.col("score"), [quantile]).first()[0] if known else None
    threshold = threshold[0] if threshold else None
    return scored.withColumn("threshold", F.lit(threshold).cast("double")).withColumnRenamed("d", id_col)


def apply_rules(scored: DataFrame) -> DataFrame:
    """Adds base_failed (under 20 words, or over 30 % of the words repeated) and kept."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    passed = F.coalesce(F.col("score") >= F.col("threshold"), F.lit(True))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & passed)
