"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

No piece of a vocabulary may hold a blank marker after another character, so the best segmentation of a
text is that of its words (each with the markers before it).  The distinct words of a batch are segmented
together, position by position, with array operations over the trie; the text's ids are gathered from them.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.package import ship
from .ragged import gather, long_list, slices
from .scratch import small_batches

MARK = "▁"
#: Words up to so many bytes are segmented side by side; longer ones one by one.
WIDE = 96


@dataclass(frozen=True)
class Vocabulary:
    pieces: list[bytes]
    score: np.ndarray
    byte_ids: np.ndarray  # id of the piece for each byte value
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray  # id of the piece that ends at a node, or -1
    longest: int
    unknown: float


def double_array(keys: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value): the child of node s by byte c is base[s] + c if check there is s."""
    root: dict = {}
    for key, v in keys.items():
        node = root
        for c in key:
            node = node.setdefault(c, {})
        node[-1] = v
    size = 1 << 16
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    check[0] = 0
    free = 256  # slots below are left to the root's children
    todo = deque([(0, root)])
    while todo:
        s, node = todo.popleft()
        value[s] = node.get(-1, -1)
        edges = np.array(sorted(c for c in node if c >= 0), np.int64)
        if not len(edges):
            continue
        at = free - 256 if s else 1
        while True:  # the first place where all children fit, looked for in stretches
            if at + 4096 + 512 >= len(check):
                base, check, value = (np.concatenate([x, np.full(len(x), f, np.int32)]) for x, f in ((base, 0), (check, -1), (value, -1)))
            places = np.arange(max(at, 1), at + 4096)
            places = places[check[places + edges[0]] < 0]
            fits = np.flatnonzero((check[places[:, None] + edges] < 0).all(1))
            if len(fits):
                b = int(places[fits[0]])
                break
            at += 4096
        base[s] = b
        check[b + edges] = s
        while check[free] >= 0:
            free += 1
        todo.extend((b + int(c), node[int(c)]) for c in edges)
    return base, check, value


@cache
def load_vocabulary(path: str) -> Vocabulary:
    """Pieces and log scores of a model file; byte, control and unknown pieces are not in the trie."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(n)]
    plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)]
    if any(MARK in name.lstrip(MARK) for name, p in zip(names, plain, strict=True) if p):
        raise ValueError("a piece holds a blank marker inside a word")
    score = np.array([model.get_score(i) for i in range(n)])
    byte_ids = np.full(256, model.unk_id(), np.int32)
    pieces = []
    for i, name in enumerate(names):
        if model.is_byte(i):
            byte_ids[int(name[1:-1], 16)] = i
            pieces.append(bytes([int(name[1:-1], 16)]))
        else:
            pieces.append(name.replace(MARK, " ").encode() if plain[i] else b"")
    keys = {names[i].encode(): i for i in range(n) if plain[i]}
    base, check, value = double_array(keys)
    least = float(min(score[i] for i in keys.values()))
    return Vocabulary(pieces, score, byte_ids, base, check, value, max(map(len, keys)), least - 10.0)


def _char_len(lead: np.ndarray) -> np.ndarray:
    return 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)


def _backtrack(v: Vocabulary, text: np.ndarray, n: np.ndarray, back: np.ndarray, piece: np.ndarray) -> list[np.ndarray]:
    """Ids of each row of the best path; a fallback step gives its bytes."""
    rows, width = text.shape
    out = np.zeros((rows, width + 1), np.int32)
    left = np.full(rows, width + 1)
    at = n.copy()
    todo = np.flatnonzero(at > 0)
    while len(todo):
        j, i = at[todo], back[todo, at[todo]]
        ids = piece[todo, j]
        known = ids >= 0
        left[todo[known]] -= 1
        out[todo[known], left[todo[known]]] = ids[known]
        r, i2, j2 = todo[~known], i[~known], j[~known]
        for k in range(int((j2 - i2).max(initial=0))):  # from the last byte of the character
            more = j2 - 1 - k >= i2
            left[r[more]] -= 1
            out[r[more], left[r[more]]] = v.byte_ids[text[r[more], j2[more] - 1 - k]]
        at[todo] = i
        todo = todo[i > 0]
    return [out[i, left[i] :] for i in range(rows)]


def segment_block(v: Vocabulary, words: list[bytes]) -> list[np.ndarray]:
    """Viterbi over many short words side by side; of equal scores the longest last piece wins."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    width = int(n.max())
    text = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
    best = np.full((len(words), width + 1), -np.inf)
    best[:, 0] = 0
    back, piece = np.zeros(best.shape, np.int64), np.full(best.shape, -1, np.int32)
    for i in range(width):
        rows = np.flatnonzero((best[:, i] > -np.inf) & (n > i))
        if not len(rows):
            continue
        # a character by its bytes, if no piece reaches its end
        j = i + _char_len(text[rows, i])
        s = best[rows, i] + v.unknown
        better = s > best[rows, j]
        best[rows[better], j[better]], back[rows[better], j[better]], piece[rows[better], j[better]] = s[better], i, -1
        node = np.zeros(len(rows), np.int64)
        for k in range(i, min(width, i + v.longest)):
            nxt = v.base[node] + text[rows, k]
            ok = (v.check[nxt] == node) & (n[rows] > k) & ((nxt > 0) & (v.base[node] > 0))
            rows, node = rows[ok], nxt[ok].astype(np.int64)
            if not len(rows):
                break
            ids = v.value[node]
            ends = ids >= 0
            r, p = rows[ends], ids[ends]
            s = best[r, i] + v.score[p]
            better = s > best[r, k + 1]
            r, p = r[better], p[better]
            best[r, k + 1], back[r, k + 1], piece[r, k + 1] = s[better], i, p
    return _backtrack(v, text, n, back, piece)


def segment_long(v: Vocabulary, word: bytes) -> np.ndarray:
    """The same for one long word, with memory in proportion to it."""
    n = len(word)
    best, back, piece = [float("-inf")] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    best[0] = 0.0
    base, check, value, score = v.base, v.check, v.value, v.score
    for i in range(n):
        here = best[i]
        if here == float("-inf"):
            continue
        c = word[i]
        j = i + 1 + (c >= 0xC0) + (c >= 0xE0) + (c >= 0xF0)
        if here + v.unknown > best[j]:
            best[j], back[j], piece[j] = here + v.unknown, i, -1
        node = 0
        for k in range(i, min(n, i + v.longest)):
            b = base[node]
            nxt = b + word[k]
            if b <= 0 or check[nxt] != node:
                break
            node = nxt
            p = value[node]
            if p >= 0 and here + score[p] > best[k + 1]:
                best[k + 1], back[k + 1], piece[k + 1] = here + score[p], i, p
    out: list[int] = []
    j = n
    while j > 0:
        i = back[j]
        out.extend([piece[j]] if piece[j] >= 0 else v.byte_ids[list(word[i:j])][::-1].tolist())
        j = i
    return np.array(out[::-1], np.int32)


def segment_words(v: Vocabulary, words: list[bytes]) -> list[np.ndarray]:
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    for at in range(0, len(order), 8192):
        block = [i for i in order[at : at + 8192] if 0 < len(words[i]) <= WIDE]
        if block:
            for i, ids in zip(block, segment_block(v, [words[i] for i in block]), strict=True):
                out[i] = ids
    for i in order:
        if len(words[i]) > WIDE:
            out[i] = segment_long(v, words[i])
    return out


class Encoder:
    """Texts to ids, with the segmentations of words seen before in a bounded table."""

    def __init__(self, v: Vocabulary, most: int = 400_000):
        self.v, self.most = v, most
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.flat, self.lens = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        # Blanks are markers, one goes before each text, and a word takes the markers before it.
        words = [self.split(t) if t else [] for t in texts]
        each = np.fromiter(map(len, words), np.int64, len(words))
        every = list(chain.from_iterable(words))
        if len(self.at) > self.most:
            self._clear()
        pick = np.fromiter(map(self.at.get, every, repeat(-1)), np.int64, len(every))
        if len(miss := np.flatnonzero(pick < 0)):
            lacking = [every[i] for i in miss.tolist()]
            new = list(dict.fromkeys(lacking))
            ids = segment_words(self.v, [(MARK + w.replace(" ", MARK)).encode() for w in new])
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
            self.flat = np.concatenate([self.flat, *ids])
            self.lens = np.concatenate([self.lens, np.fromiter(map(len, ids), np.int64, len(ids))])
            pick[miss] = np.fromiter(map(self.at.__getitem__, lacking), np.int64, len(lacking))
        starts = np.cumsum(self.lens) - self.lens
        of = np.repeat(np.arange(len(texts)), each)
        return gather(self.flat, starts, self.lens, pick), np.bincount(of, self.lens[pick], len(texts)).astype(np.int64)

    @staticmethod
    def split(text: str) -> list[str]:
        """Words without the marker at their start; words after more than one blank keep the others."""
        parts = text.replace(MARK, " ").split(" ")
        if "" not in parts:
            return parts
        out, held = [], ""
        for p in parts[:-1]:
            if p:
                out.append(held + p)
                held = ""
            else:
                held += " "
        return [*out, held + parts[-1]]


def decode_ids(v: Vocabulary, flat: np.ndarray, lens: np.ndarray) -> list[str]:
    """Texts: the pieces' bytes with blanks for markers, without the first blank."""
    joined = np.frombuffer(b"".join(v.pieces), np.uint8)
    size = np.fromiter(map(len, v.pieces), np.int64, len(v.pieces))
    raw = gather(joined, np.cumsum(size) - size, size, flat.astype(np.int64)).tobytes()
    ends = np.concatenate([[0], np.cumsum(size[flat])])[np.cumsum(lens)] if len(flat) else np.zeros(len(lens), np.int64)
    out, at = [], 0
    for end in ends.tolist():
        out.append(raw[at + (raw[at : at + 1] == b" ") : end].decode("utf-8", "replace"))
        at = end
    return out


def _with_model(docs: DataFrame, path: str):
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))  # bounded by the vocabulary


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and ``ids``.

    A marker goes before the text, blanks become markers, and characters without a piece become byte
    pieces.  Null or empty text has no ids.  U+2581 in a text is a blank.  Repeated rows and null ids are
    rows like any other; other columns are not read; an empty table gives an empty result.
    """
    model = _with_model(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value)
        for b in slices(batches, 1):
            flat, lens = encoder.encode(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), long_list(flat, lens, pa.int32())], ["d", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t")).mapInArrow(run, f"d {kind}, ids array<int>")
    return out.withColumnRenamed("d", id_col)


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: id, ids and ``text``.  Null ids give null text, no ids an empty one."""
    model = _with_model(encoded, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = max(1, min(b.num_rows, 512))
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                col = part.column(1)
                lens = pa.compute.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                texts = decode_ids(model.value, col.flatten().to_numpy(zero_copy_only=False), lens)
                texts = [t if ok else None for t, ok in zip(texts, col.is_valid().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), col, pa.array(texts, pa.string())], ["d", "ids", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    out = encoded.select(F.col(id_col).alias("d"), F.col(ids_col).alias("ids")).mapInArrow(run, f"d {kind}, ids array<int>, text string")
    return out.withColumnRenamed("d", id_col)
