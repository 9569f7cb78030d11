"""Exact nearest rows in any number of dimensions and under any distribution.

The fitted points are cut into cells of about equal counts: level by level, each cell so far is split along its
widest dimension at approximate quantiles of its own points, so that outliers and dense places make no large
cell.  Of points in one place, those of the smallest keys stand for all: the others are nobody's nearest.  A cell is
known by its box and its number of points; the tree of boxes is broadcast, its size being bounded by ``CELLS``.

A query is first answered in its home cell, the one whose box is nearest.  Its k-th distance there bounds the distance
sought, and only a query whose bound reaches into boxes of other cells is asked again there.  Inside a cell the same
tree is built once more over leaves of a few points, for all queries of a slice together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.package import ship
from ..sources.tabular import materialize

#: Cells at most, points of a cell that are wanted where that allows them, splits of a cell, and queries of a slice.
CELLS, POINTS, WAYS, SLICE = 65_536, 8_192, 32, 16_384
#: Points of a leaf inside a cell, splits there, and queries that are taken side by side, with as many pairs at most (one query may have more).
LEAF, FORKS, SIDE, PAIRS = 16, 16, 4_096, 2_000_000


def ragged(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The stretches of whole numbers that start at ``begin``, one after the other."""
    return np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())


def norm(parts: Iterator[np.ndarray]) -> np.ndarray:
    """Euclidean norm of vectors whose coordinates come one after the other."""
    return np.sqrt(reduce(np.add, (v * v for v in parts)))


class Boxes:
    """Levels of boxes: per level arrays lo, hi (cells, dimensions), n, and the first child of each in the next level.

    Made of the lowest level and, for each level above it, the first lowest box of each of its boxes.  Coordinates are
    kept by dimension.
    """

    def __init__(self, lo: np.ndarray, hi: np.ndarray, n: np.ndarray, leaf: np.ndarray, above: list[np.ndarray]):
        self.leaf = leaf
        lo, hi = np.ascontiguousarray(lo.T), np.ascontiguousarray(hi.T)
        self.levels = [(np.minimum.reduceat(lo, b, 1), np.maximum.reduceat(hi, b, 1), np.add.reduceat(n, b)) for b in above] + [(lo, hi, n)]
        below = [*above[1:], np.arange(len(n))]
        self.child = [np.searchsorted(c, np.append(b, len(n))) for b, c in zip(above, below, strict=False)]

    def home(self, x: np.ndarray) -> np.ndarray:
        """The lowest box of each query, by its nearest box level by level."""
        x = np.ascontiguousarray(x.T)
        at = begin = np.zeros(x.shape[1], np.int64)
        end = begin + len(self.levels[0][2])
        for level, (lo, hi, _) in enumerate(self.levels):
            if level:
                begin, end = self.child[level - 1][at], self.child[level - 1][at + 1]
            at, least = begin, np.full(x.shape[1], np.inf)
            for j in range((end - begin).max(initial=0)):
                other = np.minimum(begin + j, end - 1)
                d = norm(np.maximum(np.maximum(a[other] - v, v - b[other]), 0) for v, a, b in zip(x, lo, hi, strict=True))
                at, least = np.where(d < least, other, at), np.fmin(d, least)
        return at

    def reach(self, x: np.ndarray, k: int, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) of the cells that may hold one of the ``k`` nearest points of each query, no farther than its bound if there is one."""
        q, at = self.lowest(np.ascontiguousarray(x.T), k, np.full(len(x), np.inf) if bound is None else bound)
        return q, self.leaf[at]

    def lowest(self, x: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same by number of the lowest box, in order of the queries; ``x`` is by dimension."""
        top, queries = len(self.levels[0][2]), np.arange(x.shape[1])
        q, at = np.repeat(queries, top), np.tile(np.arange(top), len(queries))
        bound = bound.copy()
        open_ = np.isinf(bound).any()
        for level, (lo, hi, n) in enumerate(self.levels):
            sides = [(a[at] - v, v - b[at]) for v, a, b in ((v[q], a, b) for v, a, b in zip(x, lo, hi, strict=True))]
            near = norm(np.maximum(np.maximum(below, over), 0) for below, over in sides)
            if open_:
                far = norm(np.maximum(np.abs(below), np.abs(over)) for below, over in sides)
                # boxes by their farthest point, until they hold k: all k nearest lie within that
                order = np.lexsort((far, q))
                held = np.cumsum(n[at][order])
                first = np.searchsorted(q[order], queries)
                held -= np.where(first > 0, held[np.maximum(first - 1, 0)], 0)[q[order]]
                enough = np.flatnonzero(held >= k)
                np.minimum.at(bound, q[order][enough], far[order][enough])
            keep = near <= bound[q] * (1 + 1e-12)
            q, at = q[keep], at[keep]
            if level < len(self.child):
                begin = self.child[level][at]
                count = self.child[level][at + 1] - begin
                if count.sum() > PAIRS and len(queries) > 1:
                    half = len(queries) // 2
                    (q, at), (q1, at1) = self.lowest(x[:, :half], k, bound[:half]), self.lowest(x[:, half:], k, bound[half:])
                    return np.concatenate([q, q1 + half]), np.concatenate([at, at1])
                q, at = np.repeat(q, count), ragged(begin, count)
        return q, at


class Leaves:
    """The points of one cell in leaves of ``size`` at most, cut like the cells."""

    def __init__(self, z: np.ndarray, size: int):
        order, begin, above = np.arange(len(z)), np.zeros(1, np.int64), []
        while (longest := (count := np.diff(np.append(begin, len(z)))).max()) > size:
            above.append(begin)
            ways = min(FORKS, -(-longest // size))
            block = np.repeat(np.arange(len(begin)), count)
            widest = (np.maximum.reduceat(z[order], begin) - np.minimum.reduceat(z[order], begin)).argmax(1)
            order = order[np.lexsort((z[order, widest[block]], block))]
            branch = (np.arange(len(z)) - begin[block]) * ways // count[block]
            begin = np.concatenate([[0], np.flatnonzero(np.diff(block * ways + branch)) + 1])
        z = z[order]
        self.order, self.z, self.begin, self.count = order, np.ascontiguousarray(z.T), begin, count
        lo, hi = np.minimum.reduceat(z, begin), np.maximum.reduceat(z, begin)
        self.boxes = Boxes(lo, hi, count, np.arange(len(begin)), [np.searchsorted(begin, b) for b in above])

    def nearest(self, x: np.ndarray, k: int, wanted: int, bound: np.ndarray, mine: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, point, distance): by query, distance and point the ``k`` nearest within the bounds whose ``own`` is not ``mine``.

        ``wanted`` is k and the points that one query may have to leave out.
        """
        own = own[self.order]
        home = self.boxes.home(x)
        p = self.begin[home][:, None] + np.arange(self.count.max())
        inside = p < (self.begin + self.count)[home][:, None]
        p = np.minimum(p, len(own) - 1)
        by = np.ascontiguousarray(x.T)
        d = np.where(inside & (own[p] != mine[:, None]), norm(v[:, None] - z[p] for v, z in zip(by, self.z, strict=True)), np.inf)
        if d.shape[1] >= k:
            bound = np.fmin(bound, np.partition(d, k - 1, axis=1)[:, k - 1])
        q, at = self.boxes.lowest(by, wanted, bound)
        ends = np.searchsorted(q, np.arange(len(x)), "right")
        pairs = np.append(0, np.cumsum(self.count[at]))[ends]
        found, begin = [], 0
        while begin < len(x):
            done = pairs[begin - 1] if begin else 0
            end = max(begin + 1, np.searchsorted(pairs, done + PAIRS, "right"))
            part = slice(ends[begin - 1] if begin else 0, ends[end - 1])
            found.append(self._select(by, q[part], at[part], k, bound, mine, own))
            begin = end
        return tuple(np.concatenate(v) for v in zip(*found, strict=True))

    def _select(self, by: np.ndarray, q: np.ndarray, at: np.ndarray, k: int, bound: np.ndarray, mine: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = ragged(self.begin[at], self.count[at])
        q = np.repeat(q, self.count[at])
        d = norm(v[q] - z[p] for v, z in zip(by, self.z, strict=True))
        keep = (d <= bound[q] * (1 + 1e-12)) & np.isfinite(d) & (own[p] != mine[q])
        q, p, d = q[keep], self.order[p[keep]], d[keep]
        order = np.lexsort((p, d, q))
        q, p, d = q[order], p[order], d[order]
        ok = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[ok], p[ok], d[ok]


def cells_of(points: DataFrame, dims: int, n: int) -> tuple[DataFrame, Boxes]:
    """(``points`` with their cell, the boxes); ``x`` is the array of coordinates."""
    wanted = min(CELLS, max(1, n // POINTS))
    points, ways = points.withColumn("cell", F.lit(0).cast("long")).withColumn("path", F.array().cast("array<bigint>")), []
    while math.prod(ways) < wanted:
        ways.append(min(WAYS, -(-wanted // max(1, math.prod(ways)))))
        probs = F.array(*[F.lit(i / ways[-1]) for i in range(1, ways[-1])])
        each = []
        for d in range(dims):
            v = F.get("x", F.lit(d))
            each.append(F.struct((F.max(v) - F.min(v)).alias("spread"), F.lit(d).alias("d"), F.percentile_approx(v, probs, 100 * ways[-1]).alias("cuts")))
        widest = F.array_max(F.array(*each)).alias("by")
        cuts = materialize(points.groupBy(F.col("cell").alias("of")).agg(widest), "cuts")
        joined = points.join(F.broadcast(cuts), F.col("cell") == F.col("of"))  # CELLS rows at most
        value = F.get("x", F.col("by.d"))
        branch = F.size(F.filter("by.cuts", lambda c: c < value)).cast("long")
        points = joined.withColumn("branch", branch)
        points = points.withColumn("cell", F.col("cell") * ways[-1] + F.col("branch")).withColumn("path", F.concat("path", F.array("branch"))).drop("of", "by", "branch")
    points = materialize(points, "cells")
    side = [f(F.get("x", F.lit(i))).alias(f"{name}{i}") for name, f in (("lo", F.min), ("hi", F.max)) for i in range(dims)]
    leaves = points.groupBy("cell", "path").agg(F.count("*").alias("n"), *side).toPandas()  # CELLS rows at most
    path = np.array(leaves["path"].tolist(), np.int64).reshape(len(leaves), len(ways))
    order = np.lexsort(path.T[::-1]) if ways else np.arange(len(leaves))
    path = path[order]
    above = [np.concatenate([[0], np.flatnonzero((path[1:, :k] != path[:-1, :k]).any(1)) + 1]) for k in range(len(ways))]
    lo, hi = (np.stack([leaves[f"{name}{i}"].to_numpy(float) for i in range(dims)], 1)[order] for name in ("lo", "hi"))
    return points.drop("path"), Boxes(lo, hi, leaves.n.to_numpy()[order], leaves.cell.to_numpy()[order], above)


def coordinates(x: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), dims)


def nearest(queries: DataFrame, points: DataFrame, dims: int, k: int, own: bool, keep: list[str] | None = None) -> DataFrame:
    """(row, near): for each query (row, key, x) its ``k`` nearest points (key, label, x) as structs (d, key, label).

    Distances are Euclidean, equal ones are ordered by key (null first), and with ``own`` a point of the query's own
    key does not count; a null key is nobody's own.  There are fewer where there are fewer points, and no row where there
    are none; with ``keep`` every query has a row, near being empty then, and its columns of these names.  Coordinates
    may not be null; what is not at a finite distance is not near.
    """
    spark = queries.sparkSession
    ship(spark)
    kept = [] if keep is None else keep
    queries = queries.select(F.col("row").cast("long").alias("row"), "key", "x", *kept)
    near_type = T.ArrayType(T.StructType().add("d", "double").add("key", points.schema["key"].dataType).add("label", "double"))
    points = points.select("key", F.col("label").cast("double").alias("label"), "x").filter(F.forall("x", lambda v: F.abs(v) < math.inf))
    points = materialize(points, "points")
    copies = points.groupBy("key").agg(F.count("*").alias("n"))
    n, copies = copies.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max(F.when(F.col("key").isNotNull(), F.col("n"))), F.lit(0))).first()
    if not n:
        none = queries.select("row", *kept, F.array().cast(near_type).alias("near"))
        return none.limit(0) if keep is None else none
    wanted = k + copies if own else k
    # a query leaves out as many points as there are copies of a key, so no place needs more than these
    place = Window.partitionBy(*[F.get("x", F.lit(i)) for i in range(dims)]).orderBy("key", "label")
    points = materialize(points.withColumn("_rank", F.row_number().over(place)).filter(F.col("_rank") <= wanted).drop("_rank"), "places")
    points, boxes = cells_of(points, dims, points.count())
    tree = spark.sparkContext.broadcast(boxes)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = coordinates(b.column("x"), dims)
            home = [tree.value.home(x[at : at + SIDE]) for at in range(0, len(x), SIDE)]
            cell = tree.value.leaf[np.concatenate(home)] if home else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int64())], [*b.schema.names, "cell"])

    asked = queries.mapInArrow(walk, T.StructType([*queries.schema.fields, T.StructField("cell", T.LongType())]))
    asked = materialize(asked.withColumn("bound", F.lit(math.inf)), "asked")
    answered = T.StructType([*asked.drop("cell", "bound").schema.fields, T.StructField("near", near_type), T.StructField("further", T.ArrayType(T.LongType()))])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, cell = left.num_rows, left.column("cell")[0].as_py() if left.num_rows else 0
        right = right.slice(0, right.num_rows if rows else 0)
        right = right.take(pc.sort_indices(right, [("key", "ascending"), ("label", "ascending")], null_placement="at_start"))
        x, bound = coordinates(left.column("x"), dims), left.column("bound").to_numpy()
        theirs, mine = np.full(right.num_rows, -1), np.full(rows, -2)  # numbers of the keys; null and without own: never equal
        if own:
            keys = pa.chunked_array([*right.column("key").chunks, *left.column("key").cast(right.schema.field("key").type).chunks], right.schema.field("key").type)
            codes = keys.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            theirs, mine = codes[: right.num_rows], np.where(codes[right.num_rows :] < 0, -2, codes[right.num_rows :])
        leaves = Leaves(coordinates(right.column("x"), dims), max(LEAF, 2 * k)) if right.num_rows else None
        q, p, d, further, count = [], [], [], [], np.zeros(rows, np.int64)
        for at in range(0, rows if leaves else 0, SIDE):
            part = slice(at, at + SIDE)
            found = leaves.nearest(x[part], k, wanted, bound[part], mine[part], theirs)
            held = np.bincount(found[0], minlength=len(x[part]))
            last = np.cumsum(held) - 1
            kth = np.where(held >= k, found[2][np.maximum(last, 0)] if len(last) and len(found[2]) else np.inf, np.inf)
            for all_, one in zip((q, p, d), found, strict=True):
                all_.append(one)
            count[part] = held
            further.append(tree.value.reach(x[part], wanted, np.minimum(kth, bound[part])))
            further[-1] = (further[-1][0] + at, further[-1][1])
        join = lambda a, kind: np.concatenate([*a, np.zeros(0, kind)]).astype(kind)
        p, d = join(p, np.int64), join(d, float)
        near = pa.StructArray.from_arrays([pa.array(d), right.column("key").take(pa.array(p)).combine_chunks(), right.column("label").take(pa.array(p)).combine_chunks()], ["d", "key", "label"])
        near = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), near)
        who, where = join([f[0] for f in further], np.int64), join([f[1] for f in further], np.int64)
        away = where != cell
        who, where = who[away], where[away]
        others = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(who, minlength=rows))), pa.int32()), pa.array(where, pa.int64()))
        return left.drop_columns(["cell", "bound", "slice"]).append_column("near", near).append_column("further", others)

    def answer(asked: DataFrame) -> DataFrame:
        # a cell of many queries is searched in slices, each with the cell's points
        size = asked.groupBy("cell").agg(F.ceil(F.count("*") / SLICE).cast("long").alias("slices"))
        size = F.broadcast(materialize(size, "slices"))  # CELLS rows at most
        left = asked.join(size, "cell").withColumn("slice", F.pmod(F.xxhash64("row"), F.col("slices"))).drop("slices")
        right = points.join(size, "cell").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).drop("slices")
        return left.groupBy("cell", "slice").cogroup(right.groupBy("cell", "slice")).applyInArrow(search, answered)

    found = materialize(answer(asked), "found")
    across = found.filter(F.size("further") > 0)
    # the k-th distance so far bounds what other cells have to offer
    bound = F.when(F.size("near") >= k, F.get("near", F.lit(k - 1))["d"]).otherwise(math.inf)
    again = materialize(across.select(*queries.columns, bound.alias("bound"), F.explode("further").alias("cell")), "again")
    parts = across.select("row", "near").unionByName(answer(again).select("row", "near"))
    best = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k)  # k of each cell reached
    across = across.drop("near").join(parts.groupBy("row").agg(best.alias("near")), "row")
    out = found.filter(F.size("further") == 0).unionByName(across).select("row", *kept, "near")
    return out.filter(F.size("near") > 0) if keep is None else out
