import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evenkeel.llm.packing import Plan, WordEncoder, pack_documents
from evenkeel.llm.queries import op12_packing, read, tokenizer_file

PATH = tokenizer_file("word_bpe_49k.json")
TOK = Tokenizer.from_file(PATH)
CHUNKS = WordEncoder(PATH, most=50)


def ids_of(text):
    return [*TOK.encode(text or "", add_special_tokens=False).ids, 1]


def encoded(*texts):
    flat, lens = CHUNKS.encode(pa.array(texts, pa.string()), 1)
    return [ids.tolist() for ids in np.split(flat, np.cumsum(lens))[:-1]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abS 1'.,\n\t\x1c\x85é́<|endoftext|>ΣİK日", max_size=25), max_size=4))
def test_chunks_encode_as_the_whole(texts):
    assert encoded(*texts) == [ids_of(t) for t in texts]


@pytest.mark.parametrize("text", ["x<|endoftext|>y <|startoftext|>", "It's don't 'sad' WE'LL", "a,b;c1d22e", "<| endoftext|>", " \n ", "ΟΔΟΣ. ΣΑΣ"])
def test_hard_chunks(text):
    assert encoded(text) == [ids_of(text)]


def test_very_long_text():
    rng = np.random.default_rng(5)
    words = ["".join(w) for w in rng.choice(list("abcdefgh,.é"), (2_000, 6))]
    text = " ".join(rng.choice(words, 3_000_000).tolist())
    assert len(text) > 20_000_000
    assert encoded("b", text)[1] == [*TOK.encode_batch_fast([text], add_special_tokens=False)[0].ids, 1]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="word ends"):
        WordEncoder(tokenizer_file("byte_bpe_50k.json"))


def planned(counts, size):
    plan = Plan(counts, size)
    tail = np.array([t for t, n in counts.items() for _ in range(n)], np.int64)
    rank = np.array([i for n in counts.values() for i in range(n)], np.int64)
    row, at, length, sequence, offset = plan.pieces(tail, rank)
    parts, held = defaultdict(list), defaultdict(list)
    for r, a, n, s, o in zip(*(x.tolist() for x in (row, at, length, sequence, offset)), strict=True):
        parts[r].append((a, n))
        held[s].append((o, n))
    return plan, tail, parts, held


@pytest.mark.parametrize("seed", range(60))
def test_plan_places_each_id_once_and_leaves_no_room(seed):
    rng = random.Random(seed)
    size = rng.choice([8, 16, 30, 64, 100, 2048])
    counts = {rng.randint(1, size - 1): rng.choice([1, 2, 3, rng.randint(1, 60)]) for _ in range(rng.randint(0, 40))}
    plan, tail, parts, held = planned(counts, size)
    for r, n in enumerate(tail):
        assert sum(m for _, m in parts[r]) == n and all(a + m in (n, *[b for b, _ in parts[r]]) for a, m in parts[r])
    fills = []
    for s in sorted(held):
        at = 0
        for o, n in sorted(held[s]):
            assert o == at
            at += n
        fills.append(at)
    assert sorted(held) == list(range(len(fills))) and fills == [size] * plan.packs + plan.small


def test_lengths_that_fit_are_not_cut():
    _, _, parts, held = planned({6: 3, 3: 1, 2: 4, 1: 3}, 8)
    assert all(len(p) == 1 for p in parts.values()) and len(held) == 4


def test_steps_do_not_grow_with_the_counts():
    rng = np.random.default_rng(0)
    steps = []
    for n in (10**5, 10**7, 10**9):
        counts = {i + 1: int(c) for i, c in enumerate(n * rng.dirichlet(np.ones(2047))) if c >= 1} | {1: n // 3}
        steps.append(len(Plan(counts, 2048).by_tail["room"]))
    assert max(steps) < 20_000 and steps[2] < 2 * steps[1]


def holds_contract(rows, texts, size):
    """``texts``: (id, text) of every document; ``rows``: pieces with ids_crc32."""
    left = defaultdict(list)
    for d, t in texts:
        left[d].append(ids_of(t))
    pieces, held = defaultdict(list), defaultdict(list)
    for d, start, length, crc, total, sequence, offset in rows:
        pieces[d].append((start, length, crc, total))
        held[sequence].append((offset, length))
    want, got = [], []
    assert set(pieces) == set(left)
    for d, every in left.items():
        if len(every) == 1:
            at = 0
            for start, length, crc, total in sorted(pieces[d]):
                assert start == at and total == len(every[0])
                assert crc == zlib.crc32(np.array(every[0][start : start + length], "<u4").tobytes())
                at += length
            assert at == len(every[0])
        want.append(sum(map(len, every)))
        got.append(sum(p[1] for p in pieces[d]))
    assert want == got
    short = []
    for x in held.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at and length > 0
            at += length
        assert at <= size and (at == size or at & (at - 1) == 0)
        short += [at] if at < size else []
    assert len(set(short)) == len(short) and sum(short) < size


def test_query(spark, sf):
    texts = [(r.doc_id, r.text) for r in read(spark, sf, "documents").collect()]
    holds_contract([tuple(r) for r in op12_packing(spark, sf).collect()], texts, 2048)


@pytest.mark.parametrize("size", [16, 512])
def test_odd_rows(spark, odd, none, size):
    found = pack_documents(odd.repartition(3), PATH, size).collect()
    rows = [(r.doc_id, r.start, r.length, zlib.crc32(r.ids), r.doc_tokens, r.sequence_id, r.offset) for r in found]
    holds_contract(rows, [(r.doc_id, r.text) for r in odd.collect()], size)
    assert pack_documents(none, PATH, size).collect() == []


def test_without_broadcast(spark, odd, monkeypatch):
    monkeypatch.setattr("evenkeel.llm.packing.BROADCAST_ROWS", 0)
    found = pack_documents(odd, PATH, 64).collect()
    holds_contract([(r.doc_id, r.start, r.length, zlib.crc32(r.ids), r.doc_tokens, r.sequence_id, r.offset) for r in found], [(r.doc_id, r.text) for r in odd.collect()], 64)
