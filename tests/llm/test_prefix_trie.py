import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from evenkeel.llm import prefix_trie as module
from evenkeel.llm.prefix_trie import SparseTable, Trie, prefix_trie
from evenkeel.llm.queries import op11_prefix_trie, read

SCHEMA = "conv_id long, turn long, role string, text string, c string, part string, words string"


def brute(rows):
    """Nodes by dictionaries of prefixes."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append(((turn is not None, turn or 0), digest, (role, text)))
    own = {c: [t for *_, t in sorted(x)] for c, x in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def under(p):
        todo, out = [p], []
        while todo:
            q = todo.pop()
            out.append(q)
            todo += kids.get(q, [])
        return out

    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    out = []
    for p, cs in members.items():
        below = under(p)
        ends = ",".join(map(str, sorted(c for c in cs if len(rebuilt[c]) == len(p))))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids.get(p, [])), sum(q not in kids for q in below), sum((len(members[q]) - 1) * words(q) for q in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def nodes(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def many_ranges(spark, monkeypatch):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    monkeypatch.setattr(module, "STRETCH_IDS", 3)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_query(spark, sf, many_ranges):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in read(spark, sf, "conversations").collect()]
    assert nodes(op11_prefix_trie(spark, sf)) == brute(rows)


@pytest.mark.parametrize("seed", range(3))
def test_odd_tables(spark, many_ranges, seed):
    """Nulls, ties, repeated rows, groups of copies over several ranges, turnless and long conversations."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(1000), 120):
        kind = rng.random()
        if kind < 0.4:
            turns = [("user", "one very common turn"), ("bot", "b b")]
        elif kind < 0.5:
            turns = [("user", "one very common turn")] * rng.randint(1, 60)
        else:
            turns = [(rng.choice(["user", "bot", None, ""]), rng.choice([None, "", "a", "a b", "é\tx\x0by"])) for _ in range(rng.randint(1, 5))]
        rows += [(c, rng.choice([None, i, i, i // 2]), *t) for i, t in enumerate(turns)]
    rows += rows[:20] + [(None, 1, "user", "no conversation"), (0, 0, "x", "head"), (-41, None, None, None)]
    rng.shuffle(rows)
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    assert nodes(prefix_trie(table)) == brute(rows)


def test_one_conversation_and_none(spark):
    one = [(7, 0, "user", "a b")]
    assert nodes(prefix_trie(spark.createDataFrame([(*r, "", "", "") for r in one], SCHEMA))) == brute(one)
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_very_long_text_and_conversation(spark):
    rows = [(20, i, "user", "w " * 3) for i in range(3000)] + [(21, 0, "bot", "long " * 4_000_000)]
    found = {(r.conv_id, r.depth): r for r in prefix_trie(spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA)).collect()}
    assert (20, 3000) in found and found[20, 0].n_convs == 2


def test_extents_against_scans():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 64, 100):
        values = rng.integers(0, 5, n)
        table = SparseTable(values)
        at, least = np.repeat(np.arange(n), 6), np.tile(np.arange(6), n)
        left, right = table.left_extent(at, least), table.right_extent(at, least)
        for i, d, a, b in zip(at, least, left, right, strict=True):
            assert all(values[a + 1 : i + 1] >= d) and (a == 0 or values[a] < d)
            assert all(values[i + 1 : b + 1] >= d) and (b == n - 1 or values[b + 1] < d)
        a = rng.integers(0, n, 50)
        b = np.minimum(n - 1, a + rng.integers(0, n, 50))
        assert table.minimum(a, b).tolist() == [values[i : j + 1].min() for i, j in zip(a, b, strict=True)]


def test_left_extent_of_a_new_prefix_is_its_row():
    lens = np.array([0, 1, 2, 2, 3])
    trie = Trie(np.array([1, 1, 1, 1, 2, 2, 1, 1, 2, 2, 1, 1, 2, 2, 3, 3]), lens)
    assert trie.left.tolist() == trie.row.tolist() == [0, 1, 2, 4]
    assert trie.last.tolist() == [4, 4, 4, 4] and trie.parent.tolist() == [-1, 0, 1, 2]
