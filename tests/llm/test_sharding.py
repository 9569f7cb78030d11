import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from evenkeel.llm.queries import op4_sharding, read
from evenkeel.llm.sharding import Stretches, greedy_cut, minimax_cut, shard_documents


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=9), st.integers(1, 4))
def test_minimax_is_the_best_contiguous_partition(sizes, shards):
    cut = minimax_cut(sizes, shards)
    assert cut == sorted(cut) and max(cut) < shards
    load = defaultdict(int)
    for c, s in zip(cut, sizes, strict=True):
        load[c] += s
    n = len(sizes)
    best = min(
        max(sum(sizes[a:b]) for a, b in zip((0, *c), (*c, n), strict=True))
        for k in range(min(shards, n))
        for c in combinations(range(1, n), k)
    )
    assert max(load.values()) == best


def test_greedy_reports_too_small():
    assert greedy_cut([5, 5, 5], 5, 2) is None and greedy_cut([5, 5, 5], 10, 2) == [0, 0, 1] and greedy_cut([7], 5, 3) is None


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 30), st.just(300)), min_size=1, max_size=120), st.integers(1, 7), st.integers(1, 3))
def test_opening_stretches_gives_the_cut_of_all_groups(sizes, shards, step):
    n = len(sizes)
    place = np.sort(np.random.default_rng(n).integers(-(2**63), 2**63, n))

    def summed(rows, bits):
        keys = defaultdict(list)
        for i in rows:
            keys[int(place[i]) >> (64 - bits)].append(sizes[i])
        stats = [(k, bits, sum(v), len(v), max(v)) for k, v in keys.items()]
        return Stretches(*(np.array(c, np.int64) for c in zip(*stats, strict=True)))

    all_ = summed(range(n), 1)
    while len(which := all_.unsure(shards)):
        finer = None
        for i in which.tolist():
            bits = int(all_.bits[i])
            part = summed([j for j in range(n) if int(place[j]) >> (64 - bits) == all_.key[i]], bits + step)
            finer = part if finer is None else finer.opened(np.zeros(0, np.int64), part)
        all_ = all_.opened(which, finer)
    _, capacity = all_.bounds(shards)
    cuts = all_.cuts(capacity, shards)
    ends = [*(int(all_.start[i]) for i in cuts), sum(sizes)]
    best = minimax_cut(sizes, shards)
    load = [sum(s for s, c in zip(sizes, best, strict=True) if c == k) for k in range(max(best) + 1)]
    assert np.diff([0, *ends]).tolist() == load


def check(got, texts, shards):
    assert len(got) == len(texts)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(0 <= s < shards and sorted(v) == list(range(len(v))) for s, v in slots.items())
    by_crc = defaultdict(set)
    for r in got:
        by_crc[r.text_crc32, r.size].add(r.shard)
    assert all(len(v) == 1 for v in by_crc.values())


def loads(got):
    load = defaultdict(int)
    for r in got:
        load[r.shard] += r["size"]
    return dict(load)


def best_loads(rows, shards):
    """Loads of the best partition of the whole list of groups."""
    group = defaultdict(int)
    for text, size in rows:
        group[int(np.uint64(xxhash.xxh64_intdigest(text, 42)).astype(np.int64))] += size
    sizes = [group[h] for h in sorted(group)]
    load = defaultdict(int)
    for c, s in zip(minimax_cut(sizes, shards), sizes, strict=True):
        load[c] += s
    return dict(load)


def test_query(spark, sf):
    docs = read(spark, sf, "documents").collect()
    got = op4_sharding(spark, sf).collect()
    check(got, docs, 24)
    want = {d.doc_id: (len((d.text or "").encode()) + 8, zlib.crc32((d.text or "").encode())) for d in docs}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in got} == want
    assert loads(got) == best_loads([(d.text or "", want[d.doc_id][0]) for d in docs], 24)


def test_edges(spark, odd, none):
    check(shard_documents(odd, 5).collect(), odd.collect(), 5)
    assert shard_documents(none, 5).collect() == []
    hot = spark.range(4000).selectExpr("id doc_id", "if(id % 3 = 0, 'same', concat('t', id)) text")
    for rows in (100_000, 50):  # one part and many
        got = shard_documents(hot, 6, part_rows=rows, hot_rows=1000).collect()
        check(got, hot.collect(), 6)
        assert loads(got) == best_loads([(r.text, len(r.text) + 8) for r in hot.collect()], 6)
    same = spark.range(500).selectExpr("cast(null as long) doc_id", "'one' text")
    check(shard_documents(same, 3, part_rows=20, hot_rows=100).collect(), same.collect(), 3)
    long = spark.range(3).selectExpr("id doc_id", "repeat('é ', 7000000 + cast(id as int)) text")
    assert sorted(loads(shard_documents(long, 3).collect()).values()) == [21_000_008 + 3 * i for i in range(3)]
