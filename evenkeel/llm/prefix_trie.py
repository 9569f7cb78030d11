"""Conversation prefix trie by range minima over sorted common prefixes.

Rebuilt conversations are sorted by the digests of their turns, dealt into ranges.  In a range, the common
prefix lengths of neighbours go into a sparse table of range minima.  A node of the trie is a prefix of the
rows that share it, which lie side by side: each candidate, the first row of a prefix and its depth, finds its
left and its right extent by a search of its own over the table, so members are an interval and no stack is
walked.  In order of (first row, depth) nodes are in pre-order, and a subtree is a stretch of them: sums over
subtrees are differences of running sums.

Nodes that reach the first or last row of a range may go on in the next one.  Two rows a range hold all of
them; these rows, with what each range knows of their prefixes, are solved in the same way once more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.package import ship
from .ragged import offsets
from .scratch import materialize

#: Turns of a range, about.
RANGE_TURNS = 250_000
#: Ids that a stretch of an open list holds at most.
STRETCH_IDS = 10_000
EMPTY = hashlib.sha256(b"").hexdigest()


class SparseTable:
    """Minima of stretches of a power of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def minimum(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of the values from ``left`` to ``right``, both included."""
        level = np.frexp((right - left + 1).astype(np.float64))[1] - 1
        out = np.empty(len(left), self.levels[0].dtype)
        for k, values in enumerate(self.levels):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(values[left[at]], values[right[at] + 1 - (1 << k)])
        return out

    def right_extent(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The last place from ``at`` on before a value under ``least`` comes."""
        to, n = at.copy(), len(self.levels[0])
        for k in reversed(range(len(self.levels))):
            fits = to + (1 << k) < n
            go = np.flatnonzero(fits)
            go = go[self.levels[k][to[go] + 1] >= least[go]]
            to[go] += 1 << k
        return to

    def left_extent(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first place such that all values after it up to ``at`` are ``least`` or more."""
        to = at.copy()
        for k in reversed(range(len(self.levels))):
            go = np.flatnonzero(to - (1 << k) >= 0)
            go = go[self.levels[k][to[go] + 1 - (1 << k)] >= least[go]]
            to[go] -= 1 << k
        return to


class Trie:
    """Nodes of sorted sequences: ``flat`` holds two integers a turn, ``lens`` the turns of each sequence.

    Node v is a prefix of ``depth[v]`` turns that rows ``row[v]`` to ``last[v]`` share; nodes ``v`` to
    ``after[v]`` (not included) are its subtree.
    """

    def __init__(self, flat: np.ndarray, lens: np.ndarray):
        n = len(lens)
        begin = offsets(2 * lens)[:-1]
        self.lens = lens
        # turns that a row shares with the one before; none (not even the root) for the first
        shared = np.full(n, -1)
        least = np.minimum(lens[1:], lens[:-1])
        pair = np.repeat(np.arange(n - 1), least)
        turn = np.arange(len(pair)) - np.repeat(np.cumsum(least) - least, least)
        a, b = begin[pair] + 2 * turn, begin[pair + 1] + 2 * turn
        same = (flat[a] == flat[b]) & (flat[a + 1] == flat[b + 1])
        unlike = np.flatnonzero(~same)
        shared[1:] = least
        np.minimum.at(shared, pair[unlike] + 1, turn[unlike])
        self.table = SparseTable(shared)
        new = lens - shared
        self.first = offsets(new)  # node of a row's first new prefix
        self.row = np.repeat(np.arange(n), new)
        self.depth = np.arange(len(self.row)) - self.first[self.row] + shared[self.row] + 1
        self.shared = shared
        self.left = self.table.left_extent(self.row, self.depth)
        self.last = self.table.right_extent(self.row, self.depth)
        self.after = self.first[self.last + 1]
        self.parent = self.node(self.row, self.depth - 1)

    def node(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The node of a row's prefix; -1 for a depth of -1."""
        top = self.table.left_extent(row, depth)
        return np.where(depth < 0, -1, self.first[top] + depth - self.shared[top] - 1)

    def subtree(self, values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return total[self.after] - total[np.arange(len(self.row))]


def rebuilt_turns(conversations: DataFrame, family: int = 20, heads: int = 4) -> DataFrame:
    """(c, keys, words): each conversation's turns after its family's head turns took the place of its own.

    ``keys`` holds two integers a turn, of the digest of its role and text, ``words`` the words of its text.
    """
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    turns = conversations.filter(F.col("conv_id").isNotNull())
    turns = turns.select(F.col("conv_id").cast("long").alias("c"), F.struct("turn", digest.alias("digest"), words.alias("words")).alias("t"))
    own = materialize(turns.groupBy("c").agg(F.sort_array(F.collect_list("t")).alias("own")), "turns")
    head = own.filter(F.col("c") % family == 0).select(F.col("c").alias("of"), F.slice("own", 1, heads - 1).alias("head"))
    both = own.join(head, F.col("c") - F.col("c") % family == F.col("of"), "left")
    none = F.array().cast(own.schema["own"].dataType)
    h = (F.crc32(F.col("c").cast("string")) % heads).cast("int")
    rebuilt = F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), F.slice("own", h + 1, F.size("own")))
    both = both.select("c", rebuilt.alias("turns"))

    def half(t: Column, at: int) -> Column:
        return F.conv(F.substring(t["digest"], at, 16), 16, -10).cast("long")

    keys = F.flatten(F.transform("turns", lambda t: F.array(half(t, 1), half(t, 17))))
    return both.select("c", keys.alias("keys"), F.transform("turns", lambda t: t["words"]).alias("words"))


#: A finished node; a node whose parent's name is not known yet; a row at a range's border; a stretch of a list
#: of ids; the name of a border row's prefix.
FINISHED, ORPHAN, BORDER, STRETCH, NAME = range(5)
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
_FIELDS = {
    "kind": "int", **dict.fromkeys(NODE[:-1], "bigint"), NODE[-1]: "string",
    "part": "bigint", "side": "bigint", "prefix": "string", "ids": "string", "keys": "array<bigint>", "words": "array<bigint>", "known": "array<bigint>",
}
SCHEMA = ", ".join(f"{k} {v}" for k, v in _FIELDS.items())
_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}


def _batch(kind: int, **cols) -> pa.RecordBatch:
    n = len(next(iter(cols.values())))
    cols["kind"] = np.full(n, kind, np.int32)
    arrays = [pa.array(cols[k], _ARROW[t]) if k in cols else pa.nulls(n, _ARROW[t]) for k, t in _FIELDS.items()]
    return pa.RecordBatch.from_arrays(arrays, list(_FIELDS))


def solve_range(part: int, c: np.ndarray, flat: np.ndarray, words: np.ndarray, lens: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The nodes of a sorted range that lie inside it, and what it knows of those that reach its first or last row."""
    n, trie, at = len(c), Trie(flat, lens), offsets(lens)
    least, count = SparseTable(c).minimum(trie.row, trie.last), trie.last - trie.row + 1
    border = (trie.row == 0) | (trie.last == n - 1)
    children = np.bincount(trie.parent[1:], minlength=len(trie.row))
    word = np.append(words, 0)[np.where(trie.depth > 0, at[trie.row] + trie.depth - 1, -1)]
    # sums over what lies inside
    leaves = trie.subtree((children == 0) & ~border)
    saved = trie.subtree(np.where(border, 0, (count - 1) * word))

    # rows that end in a node follow each other, by ascending id
    end = trie.node(np.arange(n), lens)
    begin = np.flatnonzero(np.diff(end, prepend=-1))
    digests, ids = np.full(len(trie.row), EMPTY, object), c.tolist()
    prefix, piece = [], []
    for node, a, b in zip(end[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), n], strict=True):
        if border[node]:
            for i in range(a, b, STRETCH_IDS):
                prefix.append(hashlib.md5(flat[2 * at[a] : 2 * at[a + 1]].tobytes()).hexdigest())
                piece.append(",".join(map(str, ids[i : min(i + STRETCH_IDS, b)])))
        else:
            digests[node] = hashlib.sha256(",".join(map(str, ids[a:b])).encode()).hexdigest()
    yield _batch(STRETCH, part=np.full(len(piece), part), side=np.arange(len(piece)), prefix=prefix, ids=piece)

    for kind, pick in ((FINISHED, ~border & ~border[trie.parent]), (ORPHAN, ~border & border[trie.parent])):
        for v in np.array_split(np.flatnonzero(pick), len(pick) // 100_000 + 1):
            up = trie.parent[v]
            values = (least[v], trie.depth[v], least[up], count[v], children[v], leaves[v], saved[v], digests[v])
            where = {"part": np.full(len(v), part), "side": (trie.row[up] > 0).astype(np.int64)} if kind == ORPHAN else {}
            yield _batch(kind, **dict(zip(NODE, values, strict=True)), **where)

    # what hangs on a border node itself, not on another one under it
    kids = np.bincount(trie.parent[~border], minlength=len(trie.row))
    under = np.flatnonzero(border & (trie.parent >= 0))
    own = [leaves.copy(), saved.copy()]
    for x, total in zip(own, (leaves, saved), strict=True):
        np.subtract.at(x, trie.parent[under], total[under])
    told = np.zeros(len(trie.row), bool)
    for side, row in enumerate((0, n - 1)[: min(n, 2)]):
        path = trie.node(np.full(lens[row] + 1, row), np.arange(lens[row] + 1))
        known = np.stack([np.where(told[path], 0, x[path]) for x in (count, least, kids, *own)])
        told[path] = True
        yield _batch(BORDER, part=[part], side=[side], keys=[flat[2 * at[row] : 2 * at[row + 1]]], words=[words[at[row] : at[row + 1]]], known=[known.reshape(-1)])


def solve_borders(part: np.ndarray, side: np.ndarray, flat: np.ndarray, words: np.ndarray, lens: np.ndarray, known: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The nodes that reach a border, from the sorted border rows of all ranges; and the names of their prefixes."""
    trie, at = Trie(flat, lens), offsets(lens)
    row = np.repeat(np.arange(len(lens)), lens + 1)
    first = offsets(lens + 1)
    depth = np.arange(len(row)) - first[row]
    node = trie.node(row, depth)
    count, least, children, leaves, saved = (np.zeros(len(trie.row), np.int64) for _ in range(5))
    told = [known[5 * first[row] + k * (lens[row] + 1) + depth] for k in range(5)]
    for x, value in zip((count, children, leaves, saved), (told[0], *told[2:]), strict=True):
        np.add.at(x, node, value)
    least += np.iinfo(np.int64).max
    has = told[0] > 0
    np.minimum.at(least, node[has], told[1][has])
    children += np.bincount(trie.parent[1:], minlength=len(trie.row))
    word = np.append(words, 0)[np.where(trie.depth > 0, at[trie.row] + trie.depth - 1, -1)]
    leaves, saved = trie.subtree(leaves + (children == 0)), trie.subtree(saved + (count - 1) * word)
    parent = pa.array(np.where(trie.parent < 0, 0, least[trie.parent]), pa.int64(), mask=trie.parent < 0)
    prefix = []
    for r in range(len(lens)):
        digest = hashlib.md5()
        for d in range(lens[r] + 1):
            if d > trie.shared[r]:
                prefix.append(digest.hexdigest())
            digest.update(flat[2 * (at[r] + d) : 2 * (at[r] + d + 1)].tobytes() if d < lens[r] else b"")
    yield _batch(FINISHED, **dict(zip(NODE[:-1], (least, trie.depth, parent, count, children, leaves, saved), strict=True)), prefix=prefix)
    yield _batch(NAME, part=part[row], side=side[row], depth=depth, conv_id=least[node])


def _ragged(columns: list[pa.Array]) -> tuple[np.ndarray, ...]:
    return tuple(c.flatten().to_numpy() for c in columns)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt conversations (see ``rebuilt_turns``), columns ``NODE``.

    ``conv_id`` is a node's smallest member, ``depth`` its turns (0: the root), ``parent_conv_id`` its parent's
    smallest member, ``n_convs`` its members, ``n_children`` and ``n_leaves`` its children and the childless
    nodes of its subtree, ``saved_tokens`` the sum over its subtree of (members - 1) times the words of the last
    turn, and ``ends_sha256`` the SHA-256 of the ids of the members that end there.

    Turns of a conversation are ordered by ``turn``, null first; equal ones, repeated rows too, by the MD5 of
    their role and text.  Null roles and texts are empty.  Rows without a ``conv_id`` belong to no conversation.
    Other columns are not read.  An empty table has no node, not even a root.  A task holds the digests of a
    conversation's turns (32 bytes a turn), never their texts.
    """
    spark = conversations.sparkSession
    ship(spark)
    rebuilt = materialize(rebuilt_turns(conversations), "rebuilt")
    total = rebuilt.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_TURNS))
    # the id lets a range end inside a sequence that very many conversations share
    ranges = rebuilt.repartitionByRange(parts, "keys", "c").sortWithinPartitions("keys", "c")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches([b for b in batches if b.num_rows] or [pa.RecordBatch.from_pylist([], schema)], schema)
        if t.num_rows:
            c, keys, words = (x.combine_chunks() for x in t.columns)
            yield from solve_range(TaskContext.get().partitionId(), c.to_numpy(), *_ragged([keys, words]), words.value_lengths().to_numpy().astype(np.int64))

    schema = pa.schema([("c", pa.int64()), ("keys", pa.list_(pa.int64())), ("words", pa.list_(pa.int64()))])
    found = materialize(ranges.mapInArrow(local, SCHEMA), "ranges")

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            part, side, keys, words, known = (x.combine_chunks() for x in pa.Table.from_batches(held).columns)
            lens = words.value_lengths().to_numpy().astype(np.int64)
            keys, words, known = _ragged([keys, words, known])
            yield from solve_borders(part.to_numpy(), side.to_numpy(), keys, words, lens, known)

    # two rows a range, in one task
    edge = found.filter(F.col("kind") == BORDER).select("part", "side", "keys", "words", "known").repartition(1).sortWithinPartitions("part", "side")
    edge = materialize(edge.mapInArrow(borders, SCHEMA), "borders")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, hashlib.sha256()
        for b in batches:
            done = []
            for prefix, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if prefix != now:
                    if now is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = prefix, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.string()) for k in (0, 1)], ["prefix", "digest"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], ["prefix", "digest"])

    # a list that spans ranges passes one task, stretch by stretch
    lists = found.filter(F.col("kind") == STRETCH).select("prefix", "ids", "part", "side")
    lists = lists.repartition(parts, "prefix").sortWithinPartitions("prefix", "part", "side").select("prefix", "ids")
    lists = lists.mapInArrow(ends, "prefix string, digest string")

    top = edge.filter(F.col("kind") == FINISHED).join(lists, "prefix", "left").withColumn("ends_sha256", F.coalesce("digest", F.lit(EMPTY)))
    names = edge.filter(F.col("kind") == NAME).select("part", "side", F.col("depth").alias("up"), F.col("conv_id").alias("name"))
    orphans = found.filter(F.col("kind") == ORPHAN).withColumn("up", F.col("depth") - 1).drop("parent_conv_id")
    orphans = orphans.join(names, ["part", "side", "up"]).withColumnRenamed("name", "parent_conv_id")
    return found.filter(F.col("kind") == FINISHED).select(*NODE).unionByName(orphans.select(*NODE)).unionByName(top.select(*NODE))
