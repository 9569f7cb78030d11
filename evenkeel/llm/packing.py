"""Packing of token sequences: shortest-pack-first over the length histogram.

Documents are encoded once and written with their ids.  What is over a multiple of the sequence length is a
tail; only the histogram of the tails' lengths (one count a length) reaches the driver, which plans patterns:
the longest length first, into the packs that are emptiest, as many packs at once as the counts allow.
Documents find their place by the rank of their tail among those of its length, so no list of documents is
ever packed in one place.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.package import ship
from .ragged import gather, slices
from .scratch import materialize
from .token_files import U32, Growing

#: What the pre-tokenizer makes of lower-case ASCII without an apostrophe.
PIECES = re.compile(r"[a-z]+|[0-9]|[^a-z0-9]+")
#: Rows of the table of rank offsets up to which it is broadcast (24 bytes each).
BROADCAST_ROWS = 300_000


class WordEncoder:
    """Ids of texts by a BPE with word ends of the tokenizers library, chunk by chunk.

    A chunk lies between blanks or line ends.  The pre-tokenizer drops white space and always cuts there, and
    the normalizer looks at no more than a character and its marks, so a text's ids are those of its chunks.
    Chunks not seen before are encoded joined by a special token; those of printable ASCII are cut into what the
    pre-tokenizer makes of them, and a tokenizer without its other steps encodes the pieces, each of which ends
    with an id of a word end.  ``most`` chunks are remembered.
    """

    def __init__(self, path: str, most: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism here
        from tokenizers import Tokenizer

        self.tok, self.most = Tokenizer.from_file(path), most
        spec = json.loads(self.tok.to_str())
        parts = [p["type"] for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        norms = [p["type"] for p in (spec["normalizer"] or {}).get("normalizers", [])]
        if parts != ["Split", "ByteLevel"] or norms != ["NFC", "Replace", "Lowercase"] or spec["model"]["end_of_word_suffix"] != "</w>":
            raise ValueError("chunks need a BPE with word ends that drops white space and lower-cases")
        self.bare = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
        vocabulary = self.tok.get_vocab()
        self.word_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.word_end[[i for name, i in vocabulary.items() if name.endswith("</w>")]] = True
        special = self.tok.get_added_tokens_decoder()
        self.specials = [t.content for t in special.values()]
        self.join_id = min(special)
        self.joint = special[self.join_id].content
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.flat, self.begin, self.lens = Growing(U32), Growing(np.int64), Growing(np.int64)

    def _append(self, chunks: list[str], flat: np.ndarray, lens: np.ndarray) -> None:
        self.at.update(zip(chunks, range(self.lens.n, self.lens.n + len(chunks)), strict=True))
        self.begin.extend(self.flat.n + np.cumsum(lens) - lens)
        self.flat.extend(flat)
        self.lens.extend(lens)

    def whole(self, texts: list[str], tok=None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        ids = [np.array(e.ids, U32) for e in (tok or self.tok).encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, U32), *ids]), np.fromiter(map(len, ids), np.int64, len(ids))

    def _joined(self, chunks: list[str], each: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """The same of chunks that hold no special token."""
        flat, _ = self.whole([self.joint.join([*chunks[i : i + each], ""]) for i in range(0, len(chunks), each)])
        end = np.flatnonzero(flat == self.join_id)
        return np.delete(flat, end), np.diff(end, prepend=-1) - 1

    def _pieces(self, pieces: list[str], each: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """The same of what the pre-tokenizer does not cut any more: lower-case, printable ASCII."""
        flat, _ = self.whole([" ".join(pieces[i : i + each]) for i in range(0, len(pieces), each)], self.bare)
        return flat, np.diff(np.flatnonzero(self.word_end[flat]), prepend=-1)

    def _learn(self, chunks: list[str]) -> None:
        plain, several, odd, other = [], [], [], []
        for c in chunks:
            if c.isalpha() and c.isascii() and c.islower():
                plain.append(c)
            elif any(s in c for s in self.specials):
                odd.append(c)
            else:
                (several if c.isascii() and c.isprintable() and "'" not in c else other).append(c)
        self._append(odd, *self.whole(odd))
        self._append(plain, *self._pieces(plain))
        self._append(other, *self._joined(other))
        if several:
            parts = [PIECES.findall(c.lower()) for c in several]
            n = np.fromiter(map(len, parts), np.int64, len(parts))
            every = list(chain.from_iterable(parts))
            new = [p for p in dict.fromkeys(every) if p not in self.at]
            self._append(new, *self._pieces(new))
            entry = np.fromiter(map(self.at.__getitem__, every), np.int64, len(every))
            flat = gather(self.flat.values, self.begin.values, self.lens.values, entry)
            total = np.concatenate([[0], np.cumsum(self.lens.values[entry])])
            ends = np.cumsum(n)
            lens = total[ends] - total[ends - n]
            keep = np.flatnonzero([c not in self.at for c in several])  # a chunk may be its own only piece
            self._append([several[i] for i in keep.tolist()], gather(flat, total[ends - n], lens, keep), lens[keep])

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with ``end_id`` after each, number of ids of each with that one)."""
        if self.lens.n > self.most:
            self._clear()
        if not self.lens.n:
            self._append(["", "\n"], np.array([end_id], U32), np.array([0, 1]))  # entry 1 is the end
        if not len(texts):
            return np.zeros(0, U32), np.zeros(0, np.int64)
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        at = parts.offsets.to_numpy().astype(np.int64)
        at -= at[0]
        coded = parts.flatten().dictionary_encode()
        names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        entry = np.fromiter(map(self.at.get, names, repeat(-1)), np.int64, len(names))
        if len(miss := np.flatnonzero(entry < 0)):
            lacking = [names[i] for i in miss.tolist()]
            self._learn(lacking)
            entry[miss] = np.fromiter(map(self.at.__getitem__, lacking), np.int64, len(lacking))
        pick = np.insert(entry[code], at[1:], 1)
        total = np.concatenate([[0], np.cumsum(self.lens.values[pick])])
        flat = gather(self.flat.values, self.begin.values, self.lens.values, pick)
        return flat, np.diff(total[at + np.arange(len(at))])


@cache
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class Plan:
    """Which sequence each tail goes to.

    A pattern is known by the room it leaves: packs of one room stand in a queue, and a step takes a number of
    packs from the head of one queue, puts ``each`` pieces of one length into all of them, and appends them to
    the queue of the room then left.  A step names its pieces by the tails' length and a stretch of their ranks.
    The number of steps depends on the lengths that occur, not on how many documents there are.

    Places are the longest length first, into the emptiest packs.  As many packs are opened as ``size`` divides
    all ids; a length that then fits nowhere is cut to the room of the emptiest packs, and what is left of it
    waits for its turn among the shorter lengths.  So each pack ends up full, and less than ``size`` ids are left
    over, which are cut into packs of powers of two.
    """

    def __init__(self, counts: dict[int, int], size: int):
        self.size = size
        total = sum(length * n for length, n in counts.items())
        self.packs, rest = divmod(total, size)
        self.small = [1 << b for b in reversed(range(size.bit_length())) if rest >> b & 1]
        steps: list[tuple[int, ...]] = []
        taken, queued = [0] * (size + 1), [0] * (size + 1)  # of the queue of each room; that of ``size``: not opened yet
        queued[size] = self.packs
        rooms: list[int] = []  # of opened packs, negative
        # (-length, tail's length, first rank, pieces, from which id of the tail on)
        runs = [(-length, length, 0, n, 0) for length, n in counts.items() if n]
        heapq.heapify(runs)
        no = fill = 0

        def most_room() -> int:
            while rooms and taken[-rooms[0]] == queued[-rooms[0]]:
                heapq.heappop(rooms)
            return -rooms[0] if rooms else 0

        while runs:
            minus, tail, first, n, at = heapq.heappop(runs)
            length, room = -minus, most_room()
            if room < length and taken[size] < self.packs:
                room, part, each = size, length, min(size // length, n)
            elif room:
                part, each = min(length, room), 1
                heapq.heappop(rooms)
                if part == length:  # as many pieces as it takes until other packs are the emptiest
                    each = min(room // length, max(1, -((most_room() - room) // length)), n)
                heapq.heappush(rooms, -room)
            else:  # all packs are full
                part = min(length, self.small[no] - fill)
                steps.append((size + 2, 0, 1, 1, part, tail, first, at, size + 3 + no, 0, fill))
                fill += part
                if fill == self.small[no]:
                    no, fill = no + 1, 0
                if part < length:
                    heapq.heappush(runs, (part - length, tail, first, 1, at + part))
                if n > 1:
                    heapq.heappush(runs, (minus, tail, first + 1, n - 1, at))
                continue
            m = min(queued[room] - taken[room], n // each)
            to = room - each * part
            steps.append((room, taken[room], m, each, part, tail, first, at, to, queued[to], size - room))
            taken[room] += m
            if to:
                heapq.heappush(rooms, -to)
            queued[to] += m
            if part < length:
                heapq.heappush(runs, (part - length, tail, first, m, at + part))
            if n > m * each:
                heapq.heappush(runs, (minus, tail, first + m * each, n - m * each, at))
        names = ("room", "head", "packs", "each", "length", "tail", "first", "at", "to", "place", "fill")
        table = np.array(steps, np.int64).reshape(-1, len(names))
        #: One entry a step: from which queue (and place there) how many packs, which pieces, to which queue and place.
        self.by_tail = dict(zip(names, table[np.lexsort((table[:, 6], table[:, 5]))].T, strict=True))
        moves = table[table[:, 0] <= size]
        self.by_queue = dict(zip(names, moves[np.lexsort((moves[:, 1], moves[:, 0]))].T, strict=True))
        self.wide = int(max(queued)) + 1
        self.keys = self.by_queue["room"] * self.wide + self.by_queue["head"]

    def sequence(self, queue: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The number of the pack at a place of a queue, which it leaves step by step until it is full."""
        queue, place = queue.copy(), place.copy()
        todo = np.flatnonzero((queue > 0) & (queue <= self.size))
        q = self.by_queue
        while len(todo):
            k = np.searchsorted(self.keys, queue[todo] * self.wide + place[todo], "right") - 1
            place[todo] += q["place"][k] - q["head"][k]
            queue[todo] = q["to"][k]
            todo = todo[queue[todo] > 0]
        return np.where(queue == 0, place, self.packs + queue - self.size - 3)

    def pieces(self, tail: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """(which input, start in the tail, length, sequence, offset) of the pieces of tails of these lengths and ranks."""
        t = self.by_tail
        low, high = np.searchsorted(t["tail"], tail), np.searchsorted(t["tail"], tail, "right")
        # of the steps of a length, those that hold the rank; a tail that is cut has several
        n = high - low
        row = np.repeat(np.arange(len(tail)), n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        k = rank[row] - t["first"][step]
        held = (k >= 0) & (k < t["packs"][step] * t["each"][step])
        row, step, k = row[held], step[held], k[held]
        j, i = np.divmod(k, t["each"][step])
        offset = t["fill"][step] + i * t["length"][step]
        return row, t["at"][step], t["length"][step], self.sequence(t["to"][step], t["place"][step] + j), offset


def encode_tails(docs: DataFrame, tokenizer_path: str, size: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(d, part, n, ids, tail, rank, full): each document's ids (unsigned 32-bit, little-endian), the length of its
    tail, and, among those of its part, the rank of the tail in its length and the full sequences before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, full = _encoder(tokenizer_path), np.zeros(size, np.int64), 0
        part = TaskContext.get().partitionId()
        for b in slices(batches, 1, 8_000_000):
            flat, lens = encoder.encode(b.column(1), end_id)
            tail = lens % size
            order = np.argsort(tail, kind="stable")
            begin = np.searchsorted(tail[order], np.arange(size))
            rank = np.empty(len(lens), np.int64)
            rank[order] = np.arange(len(lens)) - begin[tail[order]]
            rank += seen[tail]
            seen += np.bincount(tail, minlength=size)
            blocks = lens // size
            before = full + np.cumsum(blocks) - blocks
            full += int(blocks.sum())
            offsets = np.concatenate([[0], 4 * np.cumsum(lens)])
            ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(offsets), pa.py_buffer(flat.astype(U32))])
            longs = [pa.array(x) for x in (np.full(len(lens), part), lens)]
            yield pa.RecordBatch.from_arrays([b.column(0), *longs, ids.cast(pa.binary()), *[pa.array(x) for x in (tail, rank, before)]], ["d", "part", "n", "ids", "tail", "rank", "full"])

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInArrow(run, f"d {kind}, part long, n long, ids binary, tail long, rank long, full long")


def pack_documents(
    docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: id, start, length, ids, doc_tokens, sequence_id, offset.

    Each document is its ids with ``end_id`` after them; null or empty text has that id alone.  Whole blocks of
    ``size`` ids are sequences of their own; tails are packed by their histogram.  ``ids`` are the piece's ids as
    unsigned 32-bit integers, little-endian.  Every sequence holds ``size`` ids, but for the last few, which
    hold powers of two.  Repeated rows, rows of one id or of none are documents of their own; other columns are
    not read; an empty table gives an empty result.  The order of documents that share a tail length is that of
    the written parts: which sequence a document lies in depends on the layout of the input, its pieces only on
    the plan.
    """
    spark = docs.sparkSession
    table = materialize(encode_tails(docs, tokenizer_path, size, end_id, id_col, text_col), "encoded", compression="zstd")
    counts = materialize(table.groupBy("part", "tail").agg(F.count("*").alias("n"), F.sum(F.col("n") - F.col("tail")).alias("in_full")), "tails")
    # tails of a length in the parts before
    earlier = Window.partitionBy("tail").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "tail", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # one row per part
    parts = counts.groupBy("part").agg(F.sum(F.col("in_full") / size).cast("long").alias("blocks"))
    lower = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("blocks").over(lower), F.lit(0)).alias("blocks_before"))
    offsets = before.join(F.broadcast(parts), "part")
    offsets = F.broadcast(offsets) if counts.count() <= BROADCAST_ROWS else offsets

    hist = {r.tail: r.n for r in counts.groupBy("tail").agg(F.sum("n").alias("n")).collect()}  # ``size`` rows at most
    blocks = (counts.agg(F.sum("in_full")).first()[0] or 0) // size
    plan = Plan({length: n for length, n in hist.items() if length}, size)

    @F.arrow_udf("array<struct<start:bigint,length:bigint,sequence_id:bigint,offset:bigint>>")
    def place(n: pa.Array, tail: pa.Array, rank: pa.Array, full: pa.Array) -> pa.Array:
        n, tail, rank, full = (c.to_numpy(zero_copy_only=False) for c in (n, tail, rank, full))
        whole = n // size
        row = np.repeat(np.arange(len(n)), whole)
        no = np.arange(len(row)) - np.repeat(np.cumsum(whole) - whole, whole)
        r, at, length, sequence, offset = plan.pieces(tail, rank)
        cols = [(no * size, size * whole[r] + at), (np.full(len(row), size), length), (full[row] + no, blocks + sequence), (np.zeros(len(row), np.int64), offset)]
        row = np.concatenate([row, r])
        order = np.argsort(row, kind="stable")
        names = ("start", "length", "sequence_id", "offset")
        piece = pa.StructArray.from_arrays([pa.array(np.concatenate(c)[order].astype(np.int64)) for c in cols], names)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(n)))]).astype(np.int32)), piece)

    rows = table.join(offsets, ["part", "tail"])
    found = place("n", "tail", F.col("rank") + F.col("before"), F.col("full") + F.col("blocks_before"))
    pieces = rows.select("d", "n", "ids", F.explode(found).alias("p"))
    return pieces.select(
        F.col("d").alias(id_col), "p.start", "p.length",
        F.substring("ids", (F.col("p.start") * 4 + 1).cast("int"), (F.col("p.length") * 4).cast("int")).alias("ids"),
        F.col("n").alias("doc_tokens"), "p.sequence_id", "p.offset",
    )
