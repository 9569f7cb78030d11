import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs
from tokenizers import Tokenizer

from evenkeel.llm.queries import op9_token_files, read, tokenizer_file
from evenkeel.llm.token_files import ChunkEncoder, FrameReader, read_token_files, token_folder, write_token_files

PATH = tokenizer_file("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)
CHUNKS = ChunkEncoder(PATH, most=50)


def ids_of(text):
    return TOK.encode(text or "", add_special_tokens=False).ids


def encoded(*texts):
    flat, lens = CHUNKS.encode(pa.array(texts, pa.string()), 0)
    return [ids.tolist() for ids in np.split(flat, np.cumsum(lens))[:-1]]


@settings(max_examples=250, deadline=None)
@given(st.lists(st.text("ab '1.,\n\t \x1c\x85é<|endoftext|>s", max_size=25), max_size=4))
def test_chunks_encode_as_the_whole(texts):
    assert encoded(*texts) == [[*ids_of(t), 0] for t in texts]


def test_special_string():
    assert encoded("x <|endoftext|> y") == [[*ids_of("x <|endoftext|> y"), 0]]


def test_very_long_text():
    rng = np.random.default_rng(5)
    words = ["".join(w) for w in rng.choice(list("abcdefgh,.é"), (2_000, 6))]
    text = " ".join(rng.choice(words, 3_000_000).tolist())
    assert len(text) > 20_000_000
    assert encoded("b", text)[1] == [*TOK.encode_batch_fast([text], add_special_tokens=False)[0].ids, 0]


def test_query(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in read(spark, sf, "documents").collect())
    want, at = [], 0
    for i, t in docs:
        ids = [*ids_of(t), 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, op9_token_files(spark, sf).collect())) == want


def test_reader_decompresses_only_what_is_asked(spark, odd, none):
    manifest = write_token_files(odd, token_folder(spark), PATH, frame_ids=50, files=2)
    every = read_token_files(manifest).orderBy("start").collect()
    digest = {r.text: np.uint64(xxhash.xxh64_intdigest(r.text or "", 42)).astype(np.int64) for r in odd.collect()}
    rows = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, digest[r.text]))
    assert [(r.doc_id, r.ids) for r in every] == [(r.doc_id, [*ids_of(r.text), 0]) for r in rows]
    some = read_token_files(manifest, [10, 14, 999]).collect()
    assert {r.doc_id: r.ids for r in some} == {r.doc_id: r.ids for r in every if r.doc_id in (10, 14)}
    name = manifest.orderBy("part").first().file
    store, path = fs.FileSystem.from_uri(name)
    with store.open_input_file(path) as f:
        reader = FrameReader(f)
        assert len(reader.table) > 1
        reader.ids(len(reader.index) - 1)
        assert reader.last[0] == len(reader.table) - 1
    raw = bytearray(open(path, "rb").read())
    raw[int(reader.begin[1]) - 1] ^= 0xFF
    with open(path + ".bad", "wb") as f:
        f.write(raw)
    with store.open_input_file(path + ".bad") as f, pytest.raises(Exception, match="damaged|zstd|decompress"):
        FrameReader(f).frame(0)
    assert read_token_files(write_token_files(none, token_folder(spark), PATH)).collect() == []
