"""SimHash near-dedup with pivot distance tables.

Fingerprints within ``most`` differing bits agree on two of five bit blocks, which gives equi-join keys
(ten of about 26 bits) and so the groups to search.  Inside a group each fingerprint has its distances
to many reference fingerprints: a pair is discarded if any coordinate differs by more than ``most``, and
survivors are verified on their bits.  A group gives a spanning forest, never its pairs; connected
components follow by label propagation with pointer jumping.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.package import ship
from .ragged import slices
from .scratch import materialize

#: Widths of the bit blocks, from the lowest bit.
BLOCKS = (13, 13, 13, 13, 12)
REFERENCES = np.array([xxhash.xxh64_intdigest(str(i), 0) for i in range(32)], np.uint64)
#: Fingerprints of a group that meet in one task, at most twice.
CHUNK = 4096


def fingerprint(text: str | None, n: int = 3, seed: int = 42, step: int = 200_000) -> int:
    """Unsigned SimHash over word n-grams (repeats count); A-Z lower-cased, 0 without a word."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > n:
        begins, ends = begins[: len(words) - n + 1], ends[n - 1 :]
    else:
        begins, ends = begins[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(begins), step):
        b, e = begins[at : at + step].tolist(), ends[at : at + step].tolist()
        h = np.fromiter((digest(joined[i:j], seed) for i, j in zip(b, e, strict=True)), np.uint64, len(b))
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(begins)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """(d, fp): the fingerprint of each row as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            fp = np.array([fingerprint(t, n) for t in b.column(1).to_pylist()], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["d", "fp"])

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t")).mapInArrow(run, f"d {kind}, fp long")


def link_group(fp: np.ndarray, most: int = 3, tally: Counter | None = None) -> list[tuple[int, int]]:
    """Star edges (member, smallest of its component) among distinct signed fingerprints.

    ``tally`` counts the pairs: of the group, left by the first coordinate, not linked yet, left by all coordinates
    (these are verified), linked.
    """
    bits = fp.view(np.uint64)
    table = np.bitwise_count(bits[:, None] ^ REFERENCES[None, :]).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    fp, bits, table = fp[order], bits[order], table[order]
    m = len(fp)
    label = np.arange(m)
    tally = Counter() if tally is None else tally
    tally["pairs"] += m * (m - 1) // 2
    for shift in range(1, m):
        near = np.flatnonzero(table[shift:, 0] - table[:-shift, 0] <= most)
        if not len(near):
            break
        a, b = near, near + shift
        open_ = label[a] != label[b]
        tally["first"] += len(a)
        a, b = a[open_], b[open_]
        tally["open"] += len(a)
        good = np.abs(table[a] - table[b]).max(1, initial=0) <= most
        a, b = a[good], b[good]
        sure = np.bitwise_count(bits[a] ^ bits[b]) <= most
        tally["verified"] += len(a)
        tally["linked"] += int(sure.sum())
        for i, j in zip(a[sure].tolist(), b[sure].tolist(), strict=True):
            x, y = label[i], label[j]
            if x != y:
                label[label == max(x, y)] = min(x, y)
    least = np.full(m, np.iinfo(np.int64).max)
    np.minimum.at(least, label, fp)
    root = least[label]
    return [(x, r) for x, r in zip(fp.tolist(), root.tolist(), strict=True) if x != r]


def near_edges(fps: DataFrame, most: int = 3, chunk: int = CHUNK) -> DataFrame:
    """(a, b): edges whose components are those of all pairs of distinct ``fp`` within ``most`` bits."""
    at, cuts = 0, []
    for width in BLOCKS:
        cuts.append((at, width))
        at += width
    masks = [sum(((1 << w) - 1) << s for s, w in pair) for pair in combinations(cuts, len(BLOCKS) - most)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("no", "key"))
    shared = keyed.groupBy("no", "key").agg(F.count("*").alias("n")).filter("n > 1")
    rows = materialize(keyed.join(shared, ["no", "key"]), "blocks")
    # A group over ``chunk`` is dealt into chunks, and each pair of chunks is a task's group.
    rows = rows.withColumn("parts", F.ceil(F.col("n") / chunk).cast("int"))
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumns({"lo": F.least("mine", "other"), "hi": F.greatest("mine", "other")})
    # In one part there is one group; in several the group of a chunk with itself lies in its pairs.
    rows = rows.filter((F.col("parts") == 1) | (F.col("lo") != F.col("hi")))
    group = ["no", "key", "lo", "hi"]
    rows = rows.select(*group, "fp")
    parts = fps.sparkSession.conf.get("spark.sql.shuffle.partitions")
    rows = rows.repartition(int(parts), *group).sortWithinPartitions(*group, "fp")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((0, 5), np.int64)

        def edges(block: np.ndarray) -> pa.RecordBatch:
            change = np.flatnonzero((block[1:, :4] != block[:-1, :4]).any(1)) + 1
            found = [e for g in np.split(block[:, 4], change) if len(g) > 1 for e in link_group(np.ascontiguousarray(g), most)]
            a = np.array(found, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])

        for batch in batches:
            block = np.concatenate([rest, np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], 1)])
            last = np.flatnonzero((block[:, :4] != block[-1, :4]).any(1))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on in the next batch
            if cut:
                yield edges(block[:cut])
            rest = block[cut:]
        if len(rest):
            yield edges(rest)

    ship(fps.sparkSession)
    return rows.mapInArrow(link, "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each component, for nodes with an edge.

    Labels jump, so the rounds grow with the logarithm of a component's longest path; a component that is not
    settled after ``rounds`` of them is an error.
    """
    edges = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    label = materialize(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    for _ in range(rounds):
        seen = edges.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("m"))
        best = label.join(seen, F.col("node") == F.col("a")).select("node", "root", F.least("root", "m").alias("to"))
        jump = label.select(F.col("node").alias("to"), F.col("root").alias("far"))
        nxt = best.join(jump, "to", "left").select("node", F.least("to", "far").alias("root"), F.col("root").alias("was"))
        nxt = materialize(nxt, "labels")
        label = nxt.select("node", "root")
        if nxt.filter("root <> was").isEmpty():
            return label
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 3, n: int = 3
) -> DataFrame:
    """One row per input row: id, fp (signed 64-bit), component_id.

    Two documents are linked if their fingerprints differ in ``most`` bits or fewer, and the component id
    is the smallest id reachable.  Text without a word (null or empty too) has fingerprint 0 and is linked
    like any other.  Null ids are members but never a component's id, unless all its ids are null.
    Repeated rows are linked to each other.  An empty table gives an empty result; other columns are not
    read.
    """
    table = materialize(fingerprints(docs, id_col, text_col, n), "fingerprints")
    distinct = materialize(table.groupBy("fp").agg(F.min("d").alias("least"), F.count("*").alias("n")), "distinct")
    roots = components(near_edges(distinct.select("fp"), most))
    named = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", "n", F.coalesce("root", "fp").alias("root")
    )
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(named.join(least, "root").select("fp", "n", "component_id"), "named")
    # A fingerprint of a five-hundredth of the rows or more: 500 of them at most, so they are broadcast.
    total = table.count()
    is_hot = (F.col("n") >= 1000) & (F.col("n") * 500 >= total)
    hot = F.broadcast(named.filter(is_hot).select("fp", "component_id"))
    cold = table.join(hot, "fp", "left_anti").join(named.filter(~is_hot).select("fp", "component_id"), "fp")
    both = table.join(hot, "fp").select("d", "fp", "component_id").unionByName(cold.select("d", "fp", "component_id"))
    return both.withColumnRenamed("d", id_col)
