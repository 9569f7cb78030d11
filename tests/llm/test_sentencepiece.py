import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evenkeel.llm.queries import op7_sentencepiece, read, tokenizer_file
from evenkeel.llm.sentencepiece_codec import (
    MARK, Encoder, Vocabulary, decode_documents, decode_ids, double_array, encode_documents, load_vocabulary, segment_block, segment_long,
)

MODEL = tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocab():
    return load_vocabulary(MODEL)


def test_trie_finds_its_keys_only():
    keys = {b"a": 0, b"ab": 1, b"abc": 2, b"b": 3, "é".encode(): 4}
    base, check, value = double_array(keys)

    def find(word):
        node = 0
        for c in word:
            nxt = base[node] + c
            if base[node] <= 0 or check[nxt] != node:
                return -1
            node = nxt
        return value[node]

    assert all(find(k) == v for k, v in keys.items())
    assert find(b"ac") == find(b"abcd") == find("é".encode()[:1]) == -1


def tiny():
    pieces = [b"", *[bytes([i]) for i in range(256)]]
    names = {MARK: -3.0, MARK + "a": -2.0, "a": -4.0, "b": -4.0, "ab": -5.0, "aba": -6.5, "ba": -5.0, MARK + "ab": -4.5, "é": -4.0}
    at = {}
    for n in names:
        at[n.encode()] = len(pieces)
        pieces.append(n.replace(MARK, " ").encode())
    score = np.zeros(len(pieces))
    for n, s in names.items():
        score[at[n.encode()]] = s
    base, check, value = double_array(at)
    return Vocabulary(pieces, score, np.arange(1, 257, dtype=np.int32), base, check, value, max(map(len, at)), -16.5), at


def best_score(v, at, word):
    """Brute force over all segmentations."""
    text = word.decode()
    best = [0.0] + [-1e18] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(j):
            p = at.get(text[i:j].encode())
            if p is not None:
                best[j] = max(best[j], best[i] + v.score[p])
        best[j] = max(best[j], best[j - 1] + v.unknown)
    return best[-1]


def score_of(v, ids, word):
    total, i = 0.0, 0
    raw = word.decode()
    flat = b"".join(v.pieces[k] for k in ids)
    assert flat.decode() == raw.replace(MARK, " ")
    while i < len(ids):
        if ids[i] <= 256:
            lead = v.pieces[ids[i]][0]
            i += 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            total += v.unknown
        else:
            total += v.score[ids[i]]
            i += 1
    return total


@settings(max_examples=150, deadline=None)
@given(st.text("abé日x" + MARK, min_size=1, max_size=12))
def test_viterbi_is_optimal(text):
    v, at = tiny()
    word = text.encode()
    block, one = segment_block(v, [word, b"a"])[0].tolist(), segment_long(v, word).tolist()
    assert block == one
    assert abs(score_of(v, one, word) - best_score(v, at, word)) < 1e-9


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60)), max_size=4))
def test_round_trip(texts):
    v, _ = tiny()
    flat, lens = Encoder(v, most=5).encode(texts)
    assert decode_ids(v, flat, lens) == [(t or "").replace(MARK, " ") for t in texts]


def test_words_are_segmented_as_the_whole(vocab):
    text = " a  b\nthe end 日本 " + "z" * 300
    flat, _ = Encoder(vocab).encode([text])
    assert flat.tolist() == segment_long(vocab, (MARK + text.replace(" ", MARK)).encode()).tolist()


def test_query(spark, sf):
    docs = read(spark, sf, "documents")
    back = decode_documents(encode_documents(docs, MODEL), MODEL)
    want = {r.doc_id: (r.text or "").replace(MARK, " ") for r in docs.collect()}
    assert {r.doc_id: r.text for r in back.collect()} == want
    got = op7_sentencepiece(spark, sf).collect()
    assert len(got) == len(want) and all(r.n_ids > 0 for r in got if want[r.doc_id])


def test_edges(spark, odd, none):
    back = decode_documents(encode_documents(odd, MODEL), MODEL).collect()
    assert sorted(str((r.doc_id, r.text)) for r in back) == sorted(str((r.doc_id, r.text or "")) for r in odd.collect())
    assert decode_documents(encode_documents(none, MODEL), MODEL).collect() == []
    null = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in decode_documents(null, MODEL).collect()} == {1: None, 2: ""}


def plain_viterbi(v, at, text):
    """The best sum of scores over all segmentations of a text with markers, and the sum of given ids."""
    word = (MARK + text.replace(MARK, " ").replace(" ", MARK)).encode()
    best = [0.0] + [-np.inf] * len(word)
    for i in range(len(word)):
        if best[i] == -np.inf:
            continue
        c = word[i]
        step = i + 1 + (c >= 0xC0) + (c >= 0xE0) + (c >= 0xF0)
        best[step] = max(best[step], best[i] + v.unknown)
        for j in range(i + 1, min(len(word), i + v.longest) + 1):
            p = at.get(word[i:j])
            if p is not None:
                best[j] = max(best[j], best[i] + v.score[p])
    return best[-1]


def test_ids_of_the_query_are_the_best_path(spark, sf, vocab):
    at = {(p.decode("utf-8", "replace").replace(" ", MARK)).encode(): i for i, p in enumerate(vocab.pieces) if p and not np.isin(i, vocab.byte_ids)}
    docs = read(spark, sf, "documents").filter("length(text) between 1 and 1500").orderBy("doc_id").limit(25)
    lowest = {int(b) for b in vocab.byte_ids}
    for r in encode_documents(docs, MODEL).join(docs.select("doc_id", "text"), "doc_id").collect():
        total, at_byte = 0.0, 0
        for i in r.ids:
            if i in lowest:
                b = vocab.pieces[i][0]
                total += vocab.unknown if (b < 0x80 or b >= 0xC0) else 0.0  # a character's bytes count once
                at_byte += 1
            else:
                total += vocab.score[i]
        assert total == pytest.approx(plain_viterbi(vocab, at, r.text)), r.doc_id


def test_very_long_text_round_trip(spark):
    text = "a long text of many words é 日本 " * 700_000 + "x" * 200_000
    assert len(text) > 20_000_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert decode_documents(encode_documents(docs, MODEL), MODEL).first().text == text
