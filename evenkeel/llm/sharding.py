"""Sharding by minimax contiguous partition of ordered atomic groups.

Equal texts are one atomic group, and groups are ordered by the hash of their text.  The smallest feasible
capacity is found by binary search with a greedy check, and the groups are cut there.  Groups stay
distributed: the driver holds a list of stretches of neighbouring groups with their sizes, searches it for
bounds of the capacity, and opens the few stretches where a cut may still fall into finer ones, until each
of these is a single group.  The cut is then that of the whole list of groups.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize


def greedy_cut(sizes: list[int], capacity: int, shards: int) -> list[int] | None:
    """The shard of each size when each shard takes what fits in order; None if ``shards`` are too few."""
    out, shard, load = [], 0, 0
    for s in sizes:
        if load + s > capacity and load:
            shard, load = shard + 1, 0
        if s > capacity or shard >= shards:
            return None
        load += s
        out.append(shard)
    return out


def minimax_cut(sizes: list[int], shards: int) -> list[int]:
    """Shards of the contiguous partition with the smallest possible largest sum."""
    if not sizes:
        return []
    low, high = max(max(sizes), -(-sum(sizes) // shards)), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if greedy_cut(sizes, mid, shards) else (mid + 1, high)
    return greedy_cut(sizes, low, shards)


class Stretches:
    """Ordered stretches of groups: ``key`` holds the first ``bits`` bits of the groups' hashes."""

    def __init__(self, key, bits, size, groups, biggest):
        order = np.argsort(np.left_shift(key, 64 - bits), kind="stable")
        self.key, self.bits, self.size, self.groups, self.biggest = (
            np.asarray(x, np.int64)[order] for x in (key, bits, size, groups, biggest)
        )
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size

    def _reach(self, capacity: int, shards: int, short: bool) -> list[int]:
        """Where the greedy cuts fall: at the furthest if stretches could be split anywhere, or, if ``short``,
        no further than any order of the groups inside would let them."""
        at, out, total = 0, [], int(self.end[-1])
        for _ in range(shards):
            to = at + capacity
            if to >= total:
                return [*out, total]
            i = int(np.searchsorted(self.end, to, "right"))  # the stretch that holds this place
            if self.groups[i] == 1:
                to = int(self.start[i])
            elif short:
                to = max(int(self.start[i]), to - int(self.biggest[i]))
            at = max(at, to)
            out.append(at)
        return out

    def bounds(self, shards: int) -> tuple[int, int]:
        """The least capacity that may do, and the least that does with whole stretches."""

        def least(low: int, fits) -> int:
            high = int(self.end[-1])
            while low < high:
                mid = (low + high) // 2
                low, high = (low, mid) if fits(mid) else (mid + 1, high)
            return low

        floor = max(int(self.biggest.max()), -(-int(self.end[-1]) // shards))
        low = least(floor, lambda c: self._reach(c, shards, False)[-1] == self.end[-1])
        return low, least(max(low, int(self.size.max())), lambda c: self.cuts(c, shards) is not None)

    def cuts(self, capacity: int, shards: int) -> list[int] | None:
        """The first stretch of each shard but the first, whole stretches; None if ``shards`` are too few."""
        out, i = [], 0
        while (i := int(np.searchsorted(self.end, int(self.start[i]) + capacity, "right"))) < len(self.end):
            out.append(i)
            if len(out) == shards or self.size[i] > capacity:
                return None
        return out

    def unsure(self, shards: int) -> np.ndarray:
        """The stretches of several groups inside which a cut of the best partition may fall."""
        low, high = self.bounds(shards)
        open_ = np.zeros(len(self.key), bool)
        for a, b in zip(self._reach(low, shards, True), self._reach(high, shards, False), strict=False):
            open_ |= (self.start < b) & (self.end > a)
        return np.flatnonzero(open_ & (self.groups > 1))

    def opened(self, which: np.ndarray, finer: Stretches) -> Stretches:
        keep = np.ones(len(self.key), bool)
        keep[which] = False
        names = ("key", "bits", "size", "groups", "biggest")
        return Stretches(*(np.concatenate([getattr(self, n)[keep], getattr(finer, n)]) for n in names))


def _prefix(bits: int) -> Column:
    return F.shiftright("h", 64 - bits)


def _summed(groups: DataFrame, bits: int) -> Stretches:
    stats = (F.sum("size").alias("size"), F.count("*").alias("groups"), F.max("size").alias("biggest"))
    got = groups.groupBy(_prefix(bits).alias("key")).agg(*stats).toPandas()
    return Stretches(got.key, np.full(len(got), bits), got["size"], got.groups, got.biggest)


def best_cuts(groups: DataFrame, shards: int, first_bits: int = 14, most: int = 1 << 18) -> list[int]:
    """The first hash of each shard but the first, of distributed groups (h, size), ordered by h.

    At most about ``most`` stretches reach the driver at a time: ``2**first_bits`` at first, then the parts
    of those where a cut may fall.
    """
    all_ = _summed(groups, first_bits)
    if not len(all_.key):
        return []
    while len(which := all_.unsure(shards)):
        finer = None
        for bits in np.unique(all_.bits[which]).tolist():
            keys = all_.key[which[all_.bits[which] == bits]].tolist()
            more = min(64 - bits, max(1, (most // len(which)).bit_length() - 1))
            # one row a stretch to open, at most 2**first_bits of them at first
            wanted = F.broadcast(groups.sparkSession.createDataFrame([(k,) for k in keys], "p long"))
            part = _summed(groups.withColumn("p", _prefix(bits)).join(wanted, "p"), bits + more)
            finer = part if finer is None else finer.opened(np.zeros(0, np.int64), part)
        all_ = all_.opened(which, finer)
    _, capacity = all_.bounds(shards)
    return [int(np.left_shift(all_.key[i], 64 - all_.bits[i])) for i in all_.cuts(capacity, shards)]


def shard_documents(
    docs: DataFrame,
    shards: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
    overhead: int = 8,
    part_rows: int = 100_000,
    hot_rows: int = 1_000_000,
) -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, slot.

    ``size`` is the text's UTF-8 bytes plus ``overhead``; null text has the bytes, checksum and group of
    an empty one.  Equal texts share a shard, and the largest shard is as small as a contiguous partition
    of the groups allows; shards that this leaves without a group are empty.  Slots count from 0 without
    gaps in each shard.  Null and repeated ids are rows like any other.  Rows are numbered in parts of
    about ``part_rows`` by hash of id and text; of texts held by ``hot_rows`` rows or more (and a 64th of
    all) by hash of the row's place, so that even rows equal in all columns are dealt to many tasks.  An
    empty table gives an empty result.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(
        docs.select(
            F.col(id_col).alias("d"),
            (F.octet_length(t) + F.lit(overhead)).cast("long").alias("size"),
            F.crc32(t).alias("crc"),
            F.xxhash64(t).alias("h"),
        ),
        "sizes",
    )
    groups = materialize(rows.groupBy("h").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "groups")
    cuts = best_cuts(groups.select("h", "size"), shards)
    total = groups.agg(F.sum("n")).first()[0] or 0
    hot = [r.h for r in groups.filter((F.col("n") >= hot_rows) & (F.col("n") * 64 >= total)).select("h").collect()]  # 64 at most

    shard = sum((F.when(F.col("h") >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    parts = max(1, -(-total // (shards * part_rows)))
    salt = F.when(F.col("h").isin(hot), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64("d", "h"))
    rows = rows.withColumns({"shard": shard, "part": F.pmod(salt, F.lit(parts))})
    if hot:  # the place of a row is drawn once
        rows = materialize(rows, "placed")
    # One row per (shard, part).
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "part").orderBy("d", "crc", "size")
    slots = rows.withColumn("rank", F.row_number().over(inside) - 1).join(offsets, ["shard", "part"])
    return slots.select(
        F.col("d").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("offset") + F.col("rank")).alias("slot"),
    )
