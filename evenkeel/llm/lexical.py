"""Ranked lexical search by NRA over a document-partitioned index.

One scan turns each document into the numbers of its query terms and how often it holds them.  The statistics of
all documents give each such posting its impact.  A task builds impact-sorted lists of the documents it holds
and answers every query from them with sequential reads only: lists are read to equal depths, and what is read
gives each document an interval, from the sum of the impacts seen to that sum plus, for each list where it was
not seen, the impact at which reading stopped.  Reading goes deeper until no document outside the first ``top``
can reach them, ties included, and every score among the candidates is final.  The best of all tasks' best are
the result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..sources.package import ship
from .ragged import long_list, slices
from .scratch import materialize

#: Bytes of UTF-8 that belong to terms, lower-cased; all others become blanks.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Terms of the queries that are answered in one pass; more queries take more passes.
PASS_TERMS = 400_000
#: Postings of the documents that a task searches together.
SHARD_POSTINGS = 4_000_000


def terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, window by window."""
    data, at, most = text.encode().translate(TERM_BYTES), 0, 4_000_000
    while at < len(data):
        end = data.find(b" ", at + most)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def query_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, no, terms): the distinct terms of each item that has one; ``no`` tells rows of one id apart."""
    kind = items.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(set().union(*map(set, terms(t or "")))) for t in b.column(1).to_pylist()]
            words = pa.array([[w.decode() for w in x] for x in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), words], ["item", "terms"])

    ship(items.sparkSession)
    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("t")).mapInArrow(run, f"item {kind}, terms array<string>")
    return rows.filter(F.size("terms") > 0).withColumn("no", F.monotonically_increasing_id())


def term_vectors(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(d, n, codes, tfs) of each document that has a term: how many, which of the vocabulary, how often."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = shared.value.get
        for b in slices(batches, 1):
            keep, n, lens, codes, tfs = [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                held, total = Counter(), 0
                for words in terms(t or ""):
                    total += len(words)
                    held.update(map(code, words))
                held.pop(None, None)
                if total:
                    keep.append(i)
                    n.append(total)
                    lens.append(len(held))
                    codes += held.keys()
                    tfs += held.values()
            sizes = np.array(lens, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), *[long_list(np.array(x, np.int64), sizes, pa.int64()) for x in (codes, tfs)]],
                ["d", "n", "codes", "tfs"],
            )

    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"d {kind}, n long, codes array<long>, tfs array<long>")


class Lists:
    """Impact-sorted lists of one shard: ``row`` and ``impact`` of list c lie from ``begin[c]`` to ``begin[c + 1]``."""

    def __init__(self, row: np.ndarray, code: np.ndarray, impact: np.ndarray, lists: int, rows: int):
        order = np.lexsort((-impact, code))
        self.row, self.impact, self.rows = row[order], impact[order], rows
        self.begin = np.searchsorted(code[order], np.arange(lists + 1))

    def best(self, codes: np.ndarray, top: int, depth: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of all rows that score no less than the ``top``-th best, where that is above 0."""
        begin, end = self.begin[codes], self.begin[codes + 1]
        low = np.zeros(self.rows, np.int64)
        read = np.zeros(len(codes), np.int64)
        floor, alive = 0, None
        while True:
            stop = np.minimum(end - begin, depth)
            for b, r, s in zip(begin.tolist(), read.tolist(), stop.tolist(), strict=True):
                low[self.row[b + r : b + s]] += self.impact[b + r : b + s]  # a list has a row once
            read = stop
            ahead = np.where(begin + read < end, self.impact[np.minimum(begin + read, len(self.impact) - 1)], 0)
            if len(low) >= top:
                floor = max(floor, int(np.partition(low, len(low) - top)[len(low) - top]))
            # rows that no list has shown yet reach the sum of what lies ahead at most
            if ahead.sum() < max(floor, 1):
                high = low + ahead.sum()
                for b, r, a in zip(begin.tolist(), read.tolist(), ahead.tolist(), strict=True):
                    high[self.row[b : b + r]] -= a
                alive = np.flatnonzero((high >= floor) & (low > 0))
                if np.array_equal(high[alive], low[alive]):
                    return alive, low[alive]
            depth *= 2


def search(
    docs: DataFrame, items: DataFrame, top: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """One row per item and one of its ``top`` best documents with a score above 0: item, rank, id, score.

    Terms are the maximal runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased.
    With N documents that have a term, L terms in them, n in the document, tf and df of the term:
    ``w = floor(1000 ln((2N + 2) / (2 df + 1)))``, ``m = 50 + (50 n N) div L``, and the score is the sum over the
    item's distinct terms of ``w * ((10**9 tf) div (1000 tf + 20 m))``, in 64-bit integers.  Equal scores are
    ranked by ascending id, null ids last.  Rows of one id or of none are documents of their own, and so are
    items; null or empty text has no term; an item without a term, or an empty table, gives no row; other
    columns are not read.
    """
    spark = docs.sparkSession
    asked = materialize(query_terms(items, item_col, item_text_col), "asked")
    passes = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // PASS_TERMS)
    found = []
    for k in range(passes):
        part = asked.filter(F.pmod(F.xxhash64("no"), F.lit(passes)) == k).collect()  # about PASS_TERMS terms
        if part:
            found.append(_search_pass(docs, part, top, id_col, text_col))
    if not found:
        kinds = docs.schema[id_col].dataType, items.schema[item_col].dataType
        return spark.createDataFrame([], f"{item_col} {kinds[1].simpleString()}, rank int, {id_col} {kinds[0].simpleString()}, score long")
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    order = Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("d"))
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    best = best.join(F.broadcast(asked.select("no", "item")) if asked.count() <= PASS_TERMS else asked.select("no", "item"), "no")
    return best.select(F.col("item").alias(item_col), "rank", F.col("d").alias(id_col), "score")


def _search_pass(docs: DataFrame, asked: list[Row], top: int, id_col: str, text_col: str) -> DataFrame:
    """(no, d, score): the best of each task."""
    spark = docs.sparkSession
    vocabulary = {w.encode(): i for i, w in enumerate(sorted({w for r in asked for w in r.terms}))}
    vectors = materialize(term_vectors(docs, vocabulary, id_col, text_col), "vectors")
    docs_n, terms_n = vectors.agg(F.count("*"), F.sum("n")).first()
    w = np.zeros(len(vocabulary), np.int64)
    # one row a term of the vocabulary
    for r in vectors.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("df")).collect():
        w[r.code] = np.floor(1000 * np.log((2 * docs_n + 2) / (2 * r.df + 1)))
    queries = [(r.no, np.array([vocabulary[t.encode()] for t in r.terms], np.int64)) for r in asked]
    shared = spark.sparkContext.broadcast((w, queries))
    m = F.lit(50) + F.expr(f"(50 * n * {docs_n}) div {terms_n or 1}")
    rows = vectors.filter(F.size("codes") > 0).select("d", m.alias("m"), "codes", "tfs")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, queries = shared.value

        def answer(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            ids, m, codes, tfs = (c.combine_chunks() for c in t.columns)
            row = np.repeat(np.arange(len(ids)), codes.value_lengths().to_numpy())
            code, tf = codes.flatten().to_numpy(), tfs.flatten().to_numpy()
            impact = w[code] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m.to_numpy()[row]))
            lists = Lists(row, code, impact, len(w), len(ids))
            # ids in order, nulls last: ties go by them
            place = np.empty(len(ids), np.int64)
            place[pa.compute.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
            nos, rows_, scores = [], [], []
            for no, codes in queries:
                r, s = lists.best(codes, top)
                pick = np.lexsort((place[r], -s))[:top]
                nos.append(np.full(len(pick), no, np.int64))
                rows_.append(r[pick])
                scores.append(s[pick])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(nos)), ids.take(pa.array(np.concatenate(rows_))), pa.array(np.concatenate(scores))], ["no", "d", "score"])

        held, size = [], 0
        for b in batches:
            held.append(b)
            size += len(b.column(2).flatten())
            if size >= SHARD_POSTINGS:
                yield answer(held)
                held, size = [], 0
        if size:
            yield answer(held)

    return rows.mapInArrow(run, f"no long, d {kind}, score long")
