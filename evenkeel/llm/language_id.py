"""Language ID by multilingual mixture inference.

A language is a multinomial over hashed letter trigrams.  A document is a mixture of languages; EM finds
the proportions, and the set of languages is the one of best penalised likelihood (BIC) among nested
sets taken by proportion.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.package import ship
from .ragged import slices
from .scratch import small_batches

BITS = 16
UNDETERMINED = "und"
#: Languages times bytes of text that are in arrays at once, some 100 bytes each.
SLICE = 2_000_000


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, count) of the distinct trigrams, sorted by document, and which documents have a letter.

    Anything but letters separates words, and a word is padded by one blank on either side.
    """
    low = [f" {t.lower()} " for t in texts]
    lens = np.fromiter(map(len, low), np.int64, len(low))
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
    doc = np.repeat(np.arange(len(low), dtype=np.int64), lens)
    letter = letters()[codes]
    has = np.zeros(len(low), bool)
    has[doc[letter]] = True
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1] | (doc[1:] != doc[:-1])  # of a run of other characters, the first
    x, doc = np.where(letter[keep], codes[keep], 32).astype(np.uint32), doc[keep]
    if len(x) < 3:
        return doc[:0], doc[:0], doc[:0], has
    h = x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA6B) ^ x[2:] * np.uint32(0xC2B2AE35)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    key = (doc[:-2] << BITS) | (h >> np.uint32(32 - BITS)).astype(np.int64)
    key, n = np.unique(key[(doc[:-2] == doc[2:]) & has[doc[:-2]]], return_counts=True)
    return key >> BITS, key & ((1 << BITS) - 1), n, has


def em(p: np.ndarray, n: np.ndarray, starts: np.ndarray, doc: np.ndarray, theta: np.ndarray, rounds: int):
    """Proportions and log-likelihood of each document; p: (trigram, language) likelihoods up to a row's factor."""
    total = np.add.reduceat(n, starts)
    for _ in range(rounds):
        w = p * theta[doc]
        w *= (n / w.sum(1))[:, None]
        theta = np.add.reduceat(w, starts, axis=0) / total[:, None]
    return theta, np.add.reduceat(n * np.log((p * theta[doc]).sum(1)), starts)


def mixtures(logp: np.ndarray, doc: np.ndarray, bucket: np.ndarray, n: np.ndarray, rounds: int, penalty: float):
    """(documents, proportions): the mixture of the chosen language set for each document with a trigram."""
    docs, starts = np.unique(doc, return_index=True)
    local = np.repeat(np.arange(len(docs)), np.diff([*starts, len(doc)]))
    lp = logp[bucket]
    n = n.astype(np.float64)
    p = np.exp(lp - lp.max(1, keepdims=True))
    k = p.shape[1]
    total = np.add.reduceat(n, starts)
    full, top = em(p, n, starts, local, np.full((len(docs), k), 1 / k), rounds)
    order = np.argsort(-full, axis=1, kind="stable")
    out, best = np.zeros_like(full), np.full(len(docs), np.inf)
    cost = penalty * np.log(np.maximum(total, 2))  # of one more language, in units of log-likelihood
    todo = np.ones(len(docs), bool)
    for size in range(1, k + 1):
        allowed = np.zeros_like(full)
        np.put_along_axis(allowed, order[:, :size], 1.0, axis=1)
        rows = np.flatnonzero(todo)
        if not len(rows):
            break
        pick = todo[local]
        sub = np.cumsum(todo)[local[pick]] - 1
        first = np.flatnonzero(np.diff(sub, prepend=-1))
        # a little of every allowed language, so that EM can move
        theta = full[rows] * allowed[rows] + 1e-3 * allowed[rows]
        theta /= theta.sum(1, keepdims=True)
        theta, ll = em(np.maximum(p[pick], 1e-30), n[pick], first, sub, theta, 0 if size == 1 else rounds)
        score = -ll + (size - 1) * cost[rows]
        better = score < best[rows]
        best[rows[better]], out[rows[better]] = score[better], theta[better]
        # the full mixture bounds what any larger set can reach
        todo[rows] = -top[rows] + size * cost[rows] < best[rows]
    return docs, out


def fit(
    docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample_docs: int, smoothing: float = 0.5
) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities (bucket, language), from at most about ``sample_docs`` documents each.

    Learns where the language is not null and crc32 of the id as text is not 2 modulo 4.
    """
    known = docs.select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("t"), F.col(id_col).cast("string").alias("d")
    ).filter(F.col("lang").isNotNull() & F.col("t").isNotNull() & (F.coalesce(F.crc32("d"), F.lit(0)) % 4 != 2))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((1 << BITS, 0))
    share = F.lit(0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, F.lit(int(min(1.0, sample_docs / counts[lang]) * 2**20))).otherwise(share)
    sample = known.filter(F.pmod(F.xxhash64("d"), F.lit(2**20)) < share).select("lang", "t").repartition(8)
    at = {lang: i for i, lang in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(at), 1 << BITS), np.int64)
        for b in slices(batches, 1):
            doc, bucket, n, _ = trigram_counts(b.column(1).to_pylist())
            of = np.array([at[x] for x in b.column(0).to_pylist()])
            np.add.at(sums, (of[doc], bucket), n)
        i, j = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (i, j, sums[i, j])], ["i", "j", "n"])

    # a row for each language and bucket at most reaches the driver
    table = sample.mapInArrow(count, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).toPandas()
    sums = np.zeros((1 << BITS, len(langs)))
    sums[table.j.to_numpy(), table.i.to_numpy()] = table.n.to_numpy()
    sums += smoothing
    return langs, np.log(sums / sums.sum(0)).astype(np.float32)


def detect_languages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_docs: int = 2000,
    rounds: int = 12,
    penalty: float = 2.0,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score, mixture (map of the chosen set's proportions).

    The columns ``keep`` of the row follow, as they are; the text among them crosses to Python once.

    ``lang_pred`` is the language of the largest proportion and ``score`` that proportion.  Text that is
    null or has no letter is ``und`` with score 0, and so is all text where nothing can be learned (an
    empty table, or no language given).  A null id is not held out.  Only the text is read to predict;
    ``sample_docs`` bounds the labelled documents learned from, per language.
    """
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    langs, logp = fit(docs, id_col, text_col, lang_col, sample_docs)
    model = docs.sparkSession.sparkContext.broadcast((langs, logp))  # 2**BITS floats a language

    others = [c for c in keep if c != text_col]
    sent = {text_col: 1, **{c: 3 + i for i, c in enumerate(others)}}
    more = [F.col(c).alias(f"_sent{i}") for i, c in enumerate(others)]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = model.value
        for b in slices(batches, 1, SLICE // max(4, len(names))):
            rows = b.num_rows
            pred, score = np.full(rows, UNDETERMINED, object), np.zeros(rows)
            mix: list[list[tuple[str, float]]] = [[] for _ in range(rows)]
            if names:
                doc, bucket, n, _ = trigram_counts([t or "" for t in b.column(1).to_pylist()])
                if len(doc):
                    at, theta = mixtures(table, doc, bucket, n, rounds, penalty)
                    top = theta.argmax(1)
                    pred[at], score[at] = np.array(names, object)[top], np.clip(theta[np.arange(len(at)), top], 0, 1)
                    for i, row in zip(at.tolist(), theta, strict=True):
                        mix[i] = [(names[j], float(row[j])) for j in np.flatnonzero(row)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(pred, pa.string()), pa.array(score), pa.array(mix, pa.map_(pa.string(), pa.float64())), *(b.column(sent[c]) for c in keep)],
                ["d", "held_out", "lang_pred", "score", "mixture", *(f"_keep{i}" for i in range(len(keep)))],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
    kinds = "".join(f", _keep{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t"), held.alias("held_out"), *more).mapInArrow(
        predict, f"d {kind}, held_out boolean, lang_pred string, score double, mixture map<string,double>{kinds}"
    )
    return out.withColumnsRenamed({"d": id_col, **{f"_keep{i}": c for i, c in enumerate(keep)}})
