"""Groups of near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Sets of that similarity share one of the first hashes of either in any order of all hashes, of which a fifth
of the set (and one more) is taken: these are equi-join keys that miss no pair, where blocks of a fingerprint
would have to be a few bits wide.  The order is by hash, but keys that very many sets turn out to have are put
last, so that what is common does not bring texts together that share nothing else.  Pairs that share a key
are held against each other by size and, from 16 shingles on, by 128-bit SimHash, with the pivot table of
``simhash``: each fingerprint has its distances to 32 reference fingerprints, a pair is discarded if any of them
differs by more than 40, and survivors are verified on their bits.  A distance of 40 is beyond
what sets of the similarity have, so that it discards unrelated texts only.  Components of what is left hold every group whole, and inside them the sets
themselves decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.package import ship
from .ragged import slices
from .scratch import materialize, small_batches
from .simhash import components

#: Words of a shingle, and the similarity as a fraction.
WORDS, SHARE = 5, (4, 5)
#: 64-bit parts of a fingerprint, and the bits two of them may differ in.
PARTS, MOST = 2, 40
#: Shingles of a set from which on fingerprints discard.
LEAST = 16
#: Rounds of putting crowded keys last, and how many of them at most (8 bytes each): the most crowded ones.
ROUNDS, CROWDED = 3, 500_000
#: Fingerprints, or texts, of a group that meet in one task, at most twice.
CHUNK, TEXTS = 4096, 256
#: Rows that may be broadcast: a row number or a key, and two more numbers at most.
BROADCAST_ROWS = 1_000_000
_ODD = np.array([xxhash.xxh64_intdigest(f"w{i}", 0) | 1 for i in range(WORDS)], np.uint64)
#: The reference fingerprints of the pivot table.
REFERENCES = np.array([[xxhash.xxh64_intdigest(f"r{i}.{j}", 0) for j in range(PARTS)] for i in range(32)], np.uint64)
_ADD = np.array([xxhash.xxh64_intdigest(f"p{i}", 0) for i in range(PARTS)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Ascending distinct hashes of the word n-grams, A-Z lower-cased; a shorter text is one, none without a word."""
    words = (text or "").encode().lower().split()
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(WORDS, len(w))
    if not k:
        return w
    m = len(w) - k + 1
    h = np.zeros(m, np.uint64)
    for i in range(k):
        h += mix(w[i : i + m]) * _ODD[i]
    return np.unique(mix(h))


def fingerprint(hashes: np.ndarray, step: int = 50_000) -> np.ndarray:
    """SimHash of a set, ``PARTS`` words of 64 bits."""
    ones = np.zeros(64 * PARTS, np.int64)
    for at in range(0, len(hashes), step):
        h = mix(hashes[at : at + step, None] + _ADD[None, :])
        ones += np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).view(np.uint64)


def prefix(hashes: np.ndarray, last: np.ndarray | None = None) -> np.ndarray:
    """The first hashes, so many that sets of the similarity share one; those in ``last`` (ascending) come last."""
    n, (a, b) = len(hashes), SHARE
    if not n:
        return hashes
    if last is not None and len(last):
        late = last[np.minimum(np.searchsorted(last, hashes), len(last) - 1)] == hashes
        hashes = np.concatenate([hashes[~late], hashes[late]])
    return hashes[: n - -(-a * n // b) + 1]


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets have the similarity; sets without an element are alike."""
    both = np.intersect1d(x, y, assume_unique=True).size
    return both * SHARE[1] >= (len(x) + len(y) - both) * SHARE[0]


def with_sets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` and _set (a hash of the shingle set), _size, _fp, _prefix; each row once."""
    text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            names, sizes, fps, keys = [], [], [], []
            for t in b.column(text).to_pylist():
                hs = shingle_set(t)
                names.append(xxhash.xxh64_intdigest(hs.tobytes()))
                sizes.append(len(hs))
                fps.append(fingerprint(hs).view(np.int64))
                keys.append(prefix(hs).view(np.int64))
            more = [
                pa.array(np.array(names, np.uint64).view(np.int64)),
                pa.array(sizes, pa.int64()),
                pa.array(fps, pa.list_(pa.int64())),
                pa.array(keys, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "_set", "_size", "_fp", "_prefix"])

    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    out = docs.limit(0).selectExpr("*", "0L _set", "0L _size", "array(0L) _fp", "array(0L) _prefix").schema
    for f in out.fields:
        f.nullable = True
    return docs.mapInArrow(run, out)


def unite(label: np.ndarray, i: int, j: int) -> None:
    x, y = label[i], label[j]
    if x != y:
        label[label == max(x, y)] = min(x, y)


def stars(label: np.ndarray, names: np.ndarray) -> list[tuple[int, int]]:
    """(member, smallest of its component) of each member that is not the smallest."""
    least = np.full(len(label), np.iinfo(np.int64).max)
    np.minimum.at(least, label, names)
    root = least[label]
    return [(x, r) for x, r in zip(names.tolist(), root.tolist(), strict=True) if x != r]


def pivots(block: np.ndarray) -> np.ndarray:
    """Distances of each row's fingerprint to the references."""
    fp = block[:, 2:].view(np.uint64)
    return sum(np.bitwise_count(fp[:, None, j] ^ REFERENCES[None, :, j]).astype(np.int16) for j in range(PARTS))


def possible(block: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the sizes and fingerprints of rows (name, size, fp...) with their pivot table allow the similarity."""
    s, t = block[a, 1], block[b, 1]
    fits = np.minimum(s, t) * SHARE[1] >= np.maximum(s, t) * SHARE[0]
    wide = np.flatnonzero(fits & (np.minimum(s, t) >= LEAST))
    fits[wide] = False
    wide = wide[np.abs(table[a[wide]] - table[b[wide]]).max(1, initial=0) <= MOST]
    fp = block[:, 2:].view(np.uint64)
    fits[wide] = np.bitwise_count(fp[a[wide]] ^ fp[b[wide]]).sum(1) <= MOST
    return fits


def link_possible(block: np.ndarray) -> list[tuple[int, int]]:
    """Star edges among the rows of one group."""
    block = np.ascontiguousarray(block[np.argsort(block[:, 1], kind="stable")])
    m, label, table = len(block), np.arange(len(block)), pivots(block)
    for shift in range(1, m):
        a = np.flatnonzero(block[shift:, 1] * SHARE[0] <= block[:-shift, 1] * SHARE[1])
        a = a[label[a] != label[a + shift]]
        if not len(a):
            if (label == label[0]).all() or not (block[shift:, 1] * SHARE[0] <= block[:-shift, 1] * SHARE[1]).any():
                break
            continue
        a = a[possible(block, table, a, a + shift)]
        for i in a.tolist():
            unite(label, i, i + shift)
    return stars(label, block[:, 0])


def link_alike(names: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Star edges among sets of the similarity."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    names, sets = names[order], [sets[i] for i in order]
    size, label = np.array([len(s) for s in sets]), np.arange(len(sets))
    for i in range(len(sets)):
        end = np.searchsorted(size, size[i] * SHARE[1] // SHARE[0], "right")
        for j in range(i + 1, end):
            if label[i] != label[j] and alike(sets[i], sets[j]):
                unite(label, i, j)
    return stars(label, names)


def dealt(rows: DataFrame, key: str, name: str, chunk: int) -> DataFrame:
    """Rows with lo and hi: a group over ``chunk`` (its size is n) is dealt into chunks, and each pair of them is a group."""
    rows = rows.withColumn("parts", F.ceil(F.col("n") / chunk).cast("int"))
    mine = F.pmod(F.xxhash64(name), F.col("parts")).cast("int")
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumns({"lo": F.least("mine", "other"), "hi": F.greatest("mine", "other")})
    rows = rows.filter((F.col("parts") == 1) | (F.col("lo") != F.col("hi"))).drop("parts", "mine", "other", "n")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, key, "lo", "hi").sortWithinPartitions(key, "lo", "hi", name)


def edges_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])


def possible_edges(sets: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(a, b): edges whose components hold all near copies among distinct (_set, _size, _fp, _prefix)."""
    keyed = sets.select("_set", F.explode("_prefix").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    rows = materialize(keyed.join(shared, "key"), "keys")
    fps = sets.select("_set", "_size", *[F.col("_fp")[i].alias(f"f{i}") for i in range(PARTS)])
    rows = dealt(rows.join(fps, "_set"), "key", "_set", chunk)
    rows = rows.select("key", "lo", "hi", "_set", "_size", *[f"f{i}" for i in range(PARTS)])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((0, 5 + PARTS), np.int64)

        def edges(block: np.ndarray) -> pa.RecordBatch:
            cut = np.concatenate([[0], np.flatnonzero((block[1:, :3] != block[:-1, :3]).any(1)) + 1, [len(block)]])
            group, size = np.repeat(np.arange(len(cut) - 1), np.diff(cut)), np.diff(cut)
            small = np.flatnonzero(size[group] <= 8)
            some, of, found = np.ascontiguousarray(block[small, 3:]), group[small], []
            table = pivots(some)
            for shift in range(1, 8):
                a = np.flatnonzero(of[shift:] == of[:-shift])
                a = a[possible(some, table, a, a + shift)]
                found.append(np.stack([some[a + shift, 0], some[a, 0]], 1))
            pairs = [tuple(e) for e in np.unique(np.concatenate(found), axis=0).tolist()]
            for g in np.flatnonzero(size > 8).tolist():
                pairs += link_possible(block[cut[g] : cut[g + 1], 3:])
            return edges_of(pairs)

        for batch in batches:
            block = np.concatenate([rest, np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], 1)])
            last = np.flatnonzero((block[:, :3] != block[-1, :3]).any(1))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on in the next batch
            if cut:
                yield edges(block[:cut])
            rest = block[cut:]
        if len(rest):
            yield edges(rest)

    ship(sets.sparkSession)
    return rows.mapInArrow(link, "a long, b long").distinct()


def sure_edges(texts: DataFrame, chunk: int = TEXTS) -> DataFrame:
    """(a, b): edges whose components are those of all near copies within each root of (root, _set, text)."""
    size = texts.groupBy("root").agg(F.count("*").alias("n"))
    rows = dealt(texts.join(size, "root"), "root", "_set", chunk).select("root", "lo", "hi", "_set", "text")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, names, sets = None, [], []
        for b in batches:
            for *key, name, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != at:
                    if len(names) > 1:
                        yield edges_of(link_alike(np.array(names, np.int64), sets))
                    at, names, sets = key, [], []
                names.append(name)
                sets.append(shingle_set(text))
        if len(names) > 1:
            yield edges_of(link_alike(np.array(names, np.int64), sets))

    ship(texts.sparkSession)
    return rows.mapInArrow(link, "a long, b long").distinct()


def crowded(keyed: DataFrame, chunk: int) -> np.ndarray:
    """The keys that more than ``chunk`` sets have, ascending; the most crowded ones if there are too many."""
    found = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > chunk)
    return np.array([r.key for r in found.orderBy(F.desc("n"), "key").limit(CROWDED).collect()], np.int64).view(np.uint64)


def uncrowded(sets: DataFrame, texts: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``sets`` (_row, _prefix and others) with keys that more than ``chunk`` sets have put last in all prefixes.

    Only sets with such a key among theirs get new ones, from their text in ``texts`` (_row, text), which may
    bring up others, so there are some rounds; after any of them all prefixes follow one order.
    """
    last = np.zeros(0, np.uint64)
    for _ in range(ROUNDS):
        new = np.setdiff1d(crowded(sets.select(F.explode("_prefix").alias("key")), chunk), last)
        if not len(new):
            return sets
        last = np.union1d(last, new)
        shared = sets.sparkSession.sparkContext.broadcast(last)

        def again(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, 1):
                keys = [prefix(shingle_set(t), shared.value).view(np.int64) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.list_(pa.int64()))], ["_row", "_keys"])

        keys = sets.sparkSession.createDataFrame([(int(k),) for k in new.view(np.int64)], "key long")
        moved = sets.select("_row", F.explode("_prefix").alias("key")).join(F.broadcast(keys), "key", "left_semi").select("_row").distinct()
        moved = few(moved, "moved")
        fresh = texts.select("_row", "text").join(moved, "_row", "left_semi").mapInArrow(again, "_row long, _keys array<long>")
        # the table of all sets is not written again: what changed is a table beside it
        both = sets.join(few(fresh, "fresh"), "_row", "left")
        sets = both.withColumn("_prefix", F.coalesce("_keys", "_prefix")).drop("_keys")
    return sets


def few(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table, for a join that does not move the other side if it is small enough to broadcast."""
    df = materialize(df, name)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def without(rows: DataFrame, gone: DataFrame, key: str = "_row") -> DataFrame:
    """``rows`` but those whose ``key`` is in ``gone``, without moving them if these are few enough to broadcast."""
    return rows.join(few(gone.select(key), "gone"), key, "left_anti")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, one of each group of near copies: that of the smallest id.

    Two rows are linked if the Jaccard similarity of their five-word shingles is 0.8 or more, whatever
    their ids, and a group is all that links reach.  A null id comes after all others; of rows that tie,
    one stays.  Texts without a word are one group.  An empty table gives an empty result.
    """
    rows = materialize(with_sets(docs, text_col).withColumn("_row", F.monotonically_increasing_id()), "sets")
    rank = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), "_row")
    best = materialize(rows.groupBy("_set").agg(F.min(rank).alias("first")), "best")
    shown = best.select(F.col("first._row").alias("_row"))
    sets = without(rows, rows.select("_row").join(shown, "_row", "left_anti")).select("_row", "_set", "_size", "_fp", "_prefix")
    sets = uncrowded(materialize(sets, "distinct"), rows.select("_row", F.col(text_col).alias("text")))
    wide = components(possible_edges(sets))
    texts = wide.join(best, F.col("node") == F.col("_set")).select("root", "_set", F.col("first._row").alias("_row"))
    texts = rows.select("_row", F.col(text_col).alias("text")).join(few(texts, "members"), "_row").select("root", "_set", "text")
    roots = components(sure_edges(materialize(texts, "texts")))
    group = F.coalesce("root", "_set").alias("group")
    kept = best.join(roots, F.col("node") == F.col("_set"), "left").groupBy(group).agg(F.min("first").alias("first"))
    kept = kept.select(F.col("first._row").alias("_row"))
    return without(rows, rows.select("_row").join(kept, "_row", "left_anti")).select(docs.columns)
