"""Token-id files of independent zstandard frames with a seek table and checksums.

A file is
* data frames: each is one zstandard frame of little-endian unsigned 32-bit ids of whole documents;
* an index frame (skippable, magic 0x184D2A50): a zstandard frame of triples of signed 64-bit integers
  (document id, first id in the file, number of ids); the smallest integer stands for a null id;
* the seek table (skippable, magic 0x184D2A5E) of the public seekable format: for each data frame its
  compressed size, its size and the low 32 bits of its content's XXH64, then the number of frames, a
  descriptor (0x80: checksums are there) and the magic 0x8F92EAB1.
A reader finds a document in the index, its frames in the seek table, and decompresses only those.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.package import ship
from .ragged import gather, slices
from .scratch import materialize, scratch_path

INDEX_MAGIC, SEEK_MAGIC, END_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
NULL_ID = -(2**63)
U32 = np.dtype("<u4")
I64 = np.dtype("<i8")
#: Words with marks after them, a line end between two, and the pieces of that.
WORDS = re.compile(r"[A-Za-z]+[.,;:!?]*(?:\n[A-Za-z]+[.,;:!?]*)*")
PIECES = re.compile(r"[A-Za-z]+|[.,;:!?]+|\n")


class Growing:
    """An array that doubles its room as values are appended."""

    def __init__(self, dtype):
        self.room, self.n = np.zeros(1 << 12, dtype), 0

    def extend(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.room):
            more = np.zeros(max(2 * len(self.room), self.n + len(x)), self.room.dtype)
            more[: self.n] = self.room[: self.n]
            self.room = more
        self.room[self.n : self.n + len(x)] = x
        self.n += len(x)

    @property
    def values(self) -> np.ndarray:
        return self.room[: self.n]


class ChunkEncoder:
    """Ids of texts by a byte-level BPE of the tokenizers library, chunk by chunk.

    A chunk is what lies between blanks, with the blank before it.  Where the character before a blank is
    not white space the pre-tokenizer always cuts there, so a text's ids are those of its chunks; texts
    with other white space before a blank, or with a special token's string, are encoded as a whole.
    Chunks not seen before are encoded joined to a text; in its ids, each chunk begins at a blank.  A chunk
    of ASCII words, marks and line ends is cut there too, where the pre-tokenizer always cuts.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism here
        from tokenizers import Tokenizer

        self.tok, self.most = Tokenizer.from_file(path), most
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        spec = json.loads(self.tok.to_str())
        if spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("chunks need a byte-level pre-tokenizer")
        vocabulary = self.tok.get_vocab()
        self.blank = np.zeros(max(vocabulary.values()) + 1, bool)  # ids whose first byte is a blank
        self.blank[[i for name, i in vocabulary.items() if name.startswith("\u0120")]] = True
        (self.line_end,) = self.tok.encode("\n", add_special_tokens=False).ids
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}  # by the chunk without its blank
        self.head: dict[str, int] = {}  # chunks without a blank before them, at a text's start
        self.flat, self.begin, self.lens, self.plain = Growing(U32), Growing(np.int64), Growing(np.int64), Growing(bool)

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        ids = [np.array(e.ids, U32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, U32), *ids]), np.fromiter(map(len, ids), np.int64, len(ids))

    def joined(self, chunks: list[str], blank: bool, each: int = 50) -> tuple[np.ndarray, np.ndarray]:
        """The same of chunks that do not end in white space, each after a blank (and with none inside), or
        after a line end that is not theirs (and with no white space inside)."""
        mark = " " if blank else "\n"
        flat, _ = self.whole(["".join(mark + c for c in chunks[i : i + each]) for i in range(0, len(chunks), each)])
        begin = np.flatnonzero(self.blank[flat] if blank else flat == self.line_end)
        if len(begin) != len(chunks):  # chunks that together spell a special token
            return self.whole([" " * blank + c for c in chunks])
        lens = np.diff(np.append(begin, len(flat)))
        return (flat, lens) if blank else (np.delete(flat, begin), lens - 1)

    def _append(self, table: dict[str, int], chunks: list[str], ids: tuple[np.ndarray, np.ndarray]) -> None:
        flat, lens = ids
        table.update(zip(chunks, range(self.lens.n, self.lens.n + len(chunks)), strict=True))
        self.begin.extend(self.flat.n + np.cumsum(lens) - lens)
        self.flat.extend(flat)
        self.lens.extend(lens)
        # plain: the pre-tokenizer cuts before a blank that follows
        self.plain.extend(np.fromiter((c != "" and not c[-1].isspace() for c in chunks), bool, len(chunks)))

    def _look_up(self, chunks: list[str], blank: bool) -> np.ndarray:
        """Entries of the chunks (after a blank, or as they are); new ones are learned."""
        table = self.at if blank else self.head
        pick = np.fromiter(map(table.get, chunks, repeat(-1)), np.int64, len(chunks))
        if len(miss := np.flatnonzero(pick < 0)):
            lacking = [chunks[i] for i in miss.tolist()]
            one: list[str] = []
            several: list[str] = []
            other: list[str] = []
            for c in dict.fromkeys(lacking):
                if c.isalpha():
                    one.append(c)
                elif WORDS.fullmatch(c):
                    several.append(c)
                else:
                    (one if c and not c[-1].isspace() and (blank or len(c.split()) == 1) else other).append(c)
            self._append(table, one, self.joined(one, blank))
            self._append(table, other, self.whole([" " * blank + c for c in other]))
            if several:
                parts = [PIECES.findall(c) for c in several]
                n = np.fromiter(map(len, parts), np.int64, len(parts))
                first = self._look_up([p[0] for p in parts], blank)
                rest = self._look_up(list(chain.from_iterable(p[1:] for p in parts)), False)
                entry = np.insert(rest, np.cumsum(n - 1) - (n - 1), first)
                flat = gather(self.flat.values, self.begin.values, self.lens.values, entry)
                self._append(table, several, (flat, np.add.reduceat(self.lens.values[entry], np.cumsum(n) - n)))
            pick[miss] = np.fromiter(map(table.__getitem__, lacking), np.int64, len(lacking))
        return pick

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with ``end_id`` after each, number of ids of each with that one)."""
        if self.lens.n > self.most:
            self._clear()
        if not self.lens.n:
            self._append({}, [""], (np.array([end_id], U32), np.ones(1, np.int64)))  # entry 0
        if not len(texts):
            return np.zeros(0, U32), np.zeros(0, np.int64)
        parts = pa.compute.split_pattern(texts, " ")
        at = parts.offsets.to_numpy().astype(np.int64)
        at -= at[0]
        coded = parts.flatten().dictionary_encode()
        names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        first = np.zeros(len(code), bool)
        first[at[:-1]] = True
        inner = np.zeros(len(names), bool)
        inner[code[~first]] = True
        entry = np.zeros(len(names), np.int64)
        known = np.flatnonzero(inner)
        entry[known] = self._look_up([names[i] for i in known.tolist()], True)
        pick = entry[code]
        pick[at[:-1]] = self._look_up([names[i] for i in code[at[:-1]].tolist()], False)
        # all chunks but the last must end in something that is not white space
        bad = ~self.plain.values[pick]
        bad[at[1:] - 1] = False
        odd = np.add.reduceat(bad, at[:-1], dtype=np.int64) > 0
        for s in self.special:
            odd |= pa.compute.match_substring(texts, s).to_numpy(zero_copy_only=False)
        pick = np.insert(pick, at[1:], 0)  # the end id
        flat = gather(self.flat.values, self.begin.values, self.lens.values, pick)
        lens = np.add.reduceat(self.lens.values[pick], at[:-1] + np.arange(len(texts)))
        if odd.any():
            ends, pieces, done = np.cumsum(lens), [], 0
            for i in np.flatnonzero(odd).tolist():
                ids, _ = self.whole([texts[i].as_py()])
                pieces += [flat[done : ends[i] - lens[i]], ids, np.array([end_id], U32)]
                done, lens[i] = int(ends[i]), len(ids) + 1
            flat = np.concatenate([*pieces, flat[done:]])
        return flat, lens


@cache
def _encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def _skippable(magic: int, body: bytes) -> bytes:
    return np.array([magic, len(body)], U32).tobytes() + body


class FrameWriter:
    """Appends documents to an open file; frames close at ``frame_ids`` ids or more."""

    def __init__(self, out, frame_ids: int, level: int = 3):
        self.out, self.frame_ids = out, frame_ids
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.frames, self.index = Growing(I64), Growing(I64)
        self.open: list[np.ndarray] = []
        self.n_open = self.n = self.docs = 0

    def extend(self, docs: np.ndarray, flat: np.ndarray, lens: np.ndarray) -> None:
        """Documents in order: their ids one after the other, and how many each has."""
        ends = np.cumsum(lens)
        self.index.extend(np.stack([docs, self.n + ends - lens, lens], 1).reshape(-1))
        self.docs += len(docs)
        self.n += len(flat)
        at = 0
        while (k := int(np.searchsorted(ends, at + self.frame_ids - self.n_open))) < len(ends):
            self.open.append(flat[at : ends[k]])
            self._close()
            at = int(ends[k])
        self.open.append(flat[at:])
        self.n_open += len(flat) - at

    def _close(self) -> None:
        raw = np.concatenate(self.open).astype(U32).tobytes() if self.open else b""
        if raw:
            packed = self.zstd.compress(raw)
            self.out.write(packed)
            self.frames.extend(np.array([len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF], I64))
        self.open, self.n_open = [], 0

    def finish(self) -> None:
        self._close()
        self.out.write(_skippable(INDEX_MAGIC, self.zstd.compress(self.index.values.tobytes())))
        table = self.frames.values.astype(U32).tobytes() + np.array([self.frames.n // 3], U32).tobytes() + b"\x80"
        self.out.write(_skippable(SEEK_MAGIC, table + np.array([END_MAGIC], U32).tobytes()))


class FrameReader:
    """Random access to a file: ``index`` and ``ids(i)`` read only what they need."""

    def __init__(self, source):
        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        size = source.size()
        tail = self._at(size - 9, 9)
        n, (end,) = int(np.frombuffer(tail[:4], U32)[0]), np.frombuffer(tail[5:], U32)
        if end != END_MAGIC or tail[4] != 0x80:
            raise ValueError("no seek table with checksums")
        begin = size - 9 - 12 * n
        self.table = np.frombuffer(self._at(begin, 12 * n), U32).reshape(n, 3).astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        self.first = np.concatenate([[0], np.cumsum(self.table[:, 1] // 4)])
        at = int(self.begin[-1])
        magic, length = np.frombuffer(self._at(at, 8), U32).tolist()
        if magic != INDEX_MAGIC:
            raise ValueError("no index frame")
        self.index = np.frombuffer(self.zstd.decompress(self._at(at + 8, length)), I64).reshape(-1, 3)
        self.last: tuple[int, np.ndarray] = (-1, np.zeros(0, U32))

    def _at(self, begin: int, n: int) -> bytes:
        self.source.seek(begin)
        return self.source.read(n)

    def frame(self, k: int) -> np.ndarray:
        if self.last[0] != k:
            packed, size, check = self.table[k].tolist()
            raw = self.zstd.decompress(self._at(int(self.begin[k]), packed), max_output_size=size)
            if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {k} is damaged")
            self.last = (k, np.frombuffer(raw, U32))
        return self.last[1]

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document; it lies in one frame."""
        _, first, n = self.index[i].tolist()
        if not n:
            return np.zeros(0, U32)
        k = int(np.searchsorted(self.first, first, "right")) - 1
        return self.frame(k)[first - self.first[k] :][:n]


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    frame_ids: int = 65_536,
    files: int | None = None,
    file_bytes: int = 256 << 20,
) -> DataFrame:
    """Write ``docs`` to files under the URI ``path`` in ascending id order; (part, file, docs, ids) of each.

    Each document's ids end with ``end_id``.  Null or empty text has that id alone; a null id comes first;
    rows with equal ids are ordered by a hash of their text; extra columns are not read; an empty table
    writes no file.  Unless ``files`` says how many, there are as many as shuffle partitions, or one for
    each ``file_bytes`` of text if that is more.  A task writes under a name of its own and then renames,
    so that a task that runs again or twice leaves one whole file.
    """
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    if files is None:
        size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // file_bytes))
    # The hash lets a range of one id, or of null ids, lie in several files.
    rows = docs.select(F.col(id_col).cast("long").alias("d"), text.alias("t"), F.xxhash64(text).alias("h"))
    rows = rows.repartitionByRange(files, "d", "h").sortWithinPartitions("d", "h")
    rows = rows.select("d", "t", F.spark_partition_id().alias("part"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, sink = _encoder(tokenizer_path), None, None
        for b in slices(batches, 1, 8_000_000):
            if writer is None:
                part = b.column(2)[0].as_py()
                store, folder = _open(path)
                store.create_dir(folder, recursive=True)
                final, own = f"{folder}/part-{part:06d}.idz", f"{folder}/.part-{part:06d}.{uuid.uuid4().hex}"
                sink = store.open_output_stream(own)
                writer = FrameWriter(sink, frame_ids)
            ids = b.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            writer.extend(ids, *encoder.encode(b.column(1), end_id))
        if writer is not None:
            writer.finish()
            sink.close()
            store.move(own, final)
            row = [[part], [f"{path}/part-{part:06d}.idz"], [writer.docs], [writer.n]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row[0], pa.int32()), pa.array(row[1]), *[pa.array(r, pa.int64()) for r in row[2:]]],
                ["part", "file", "docs", "ids"],
            )

    return materialize(rows.mapInArrow(write, "part int, file string, docs long, ids long"), "manifest")


def read_token_files(manifest: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """(doc_id, start, ids) of every document of the files, or of the ``wanted`` ids only.

    ``start`` counts the ids of all documents before it, over all files in order.  Checksums are verified.
    """
    ship(manifest.sparkSession)
    # One row per file.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("before", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = files.select("file", "before").repartition(n, "file")
    only = None if wanted is None else np.array(sorted(wanted), np.int64)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, first in zip(*[c.to_pylist() for c in b.columns], strict=True):
                store, name = _open(file)
                with store.open_input_file(name) as source:
                    reader = FrameReader(source)
                    rows = np.arange(len(reader.index)) if only is None else np.flatnonzero(np.isin(reader.index[:, 0], only))
                    for at in range(0, len(rows), 256):
                        part = rows[at : at + 256]
                        ids = [reader.ids(i) for i in part]
                        doc = [None if d == NULL_ID else d for d in reader.index[part, 0].tolist()]
                        lens = np.fromiter(map(len, ids), np.int64, len(ids))
                        ends = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
                        flat = np.concatenate(ids).astype(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(doc, pa.int64()),
                                pa.array(reader.index[part, 1] + first),
                                pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                                pa.array([zlib.crc32(i.astype(U32).tobytes()) for i in ids], pa.int64()),
                            ],
                            ["doc_id", "start", "ids", "ids_crc32"],
                        )

    return files.mapInArrow(read, "doc_id long, start long, ids array<long>, ids_crc32 long")


def token_folder(spark: SparkSession) -> str:
    """A fresh folder in the shared scratch space, as a URI."""
    path = scratch_path(spark, "tokens")
    return path if "://" in path or path.startswith("file:") else f"file://{path}"
