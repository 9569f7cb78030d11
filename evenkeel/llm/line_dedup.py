"""Line dedup over levelled sorted runs of line hashes.

Documents are taken in batches of ascending ``doc_id``.  The keys of a batch are merge-anti-joined
with the runs written so far; what is new becomes a run of its own, and every ``fanout`` runs of a
level are compacted into one run of the next level.  Runs are bucketed and sorted by key, all into the
same number of buckets, so a batch is dealt once and merged with every run where it lies.  As batches
ascend, the first run that gets a key holds its smallest document, so a line is dropped exactly when a
run holds its key for a smaller id.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import materialize, materialize_buckets

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: U+0020 and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only.  Where all characters are ASCII the built-in ``lower`` does the same, faster."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


class LineRuns:
    """Runs of (h, g, keeper), each sorted by key; level i+1 holds ``fanout`` compacted runs of level i."""

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.fanout, self.buckets = fanout, int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = [[]]

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def all(self) -> DataFrame | None:
        runs = self.runs()
        return reduce(DataFrame.unionByName, runs) if runs else None

    def unseen(self, keys: DataFrame) -> DataFrame:
        """Merge anti-join of a batch's distinct keys with every run; no run is moved."""
        runs = self.runs()
        keys = keys.repartition(self.buckets, "h", "g") if runs else keys
        return reduce(lambda k, r: k.join(r.select("h", "g").hint("merge"), ["h", "g"], "left_anti"), runs, keys)

    def add(self, keys: DataFrame) -> None:
        """Write a batch's new keys as a sorted run and compact full levels."""
        self._put(0, keys)

    def _put(self, level: int, keys: DataFrame) -> None:
        run = materialize_buckets(keys.select("h", "g", "keeper"), f"lines-l{level}", ["h", "g"], self.buckets)
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = reduce(DataFrame.unionByName, self.levels[level])
            self.levels[level] = []
            self._put(level + 1, merged)


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 10,
    batches: int | None = None,
    fanout: int = 3,
    batch_lines: int = 2_000_000_000,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per input row: id, text with repeated lines dropped, n_lines, n_dropped.

    The columns ``keep`` of the row follow, as they are.

    A line's key is the line without U+0020 and U+0009-U+000D at its ends, A-Z lower-cased.  A key of
    ``min_chars`` code points or more that two or more documents hold keeps its lines only in the
    smallest id.  Null or empty text is one empty line; a null id counts as the smallest id and stays
    null in the result; rows with the same id are one document.  An id is an integer, or text that casts
    to one.  Other columns are not read, and an empty table gives an empty result.  Unless ``batches``
    says how many id ranges there are, it is one for each ``batch_lines`` lines, four at least.
    """
    spark = docs.sparkSession
    floor = -(2**63)
    base = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(floor)).alias("d"),
        F.coalesce(F.col(text_col), F.lit("")).alias("t"),
        F.col(id_col).cast("long").alias("id"),
        *[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)],
    )
    def key(line: Column) -> Column:
        return ascii_lower(F.btrim(line, F.lit(BLANKS)))

    # The hash of a text is taken once, before its lines are spread out.
    lines = base.select("d", F.xxhash64("t").alias("v"), F.split("t", "\n", -1).alias("ls"))
    lines = lines.select("d", "v", F.posexplode("ls").alias("pos", "line"))
    lines = lines.withColumn("k", key(F.col("line"))).filter(F.length("k") >= min_chars)
    # 96 bits name a key: 64 of one hash and 32 of another.
    lines = lines.select("d", "v", "pos", F.xxhash64("k").alias("h"), F.hash("k").alias("g"))
    lines = materialize(lines, "lines")
    total = lines.count()
    batches = batches or max(4, -(-total // batch_lines))
    cuts = lines.select(F.percentile_approx("d", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    cuts = sorted(set(cuts))

    runs = LineRuns(spark, fanout)
    for low, high in zip([floor, *(c + 1 for c in cuts)], [*cuts, 2**63 - 1], strict=True):
        keys = lines.filter(F.col("d").between(low, high)).groupBy("h", "g").agg(F.min("d").alias("keeper"))
        runs.add(runs.unseen(keys))
    keepers = runs.all()

    # A key of a two-thousandth of all lines: 2,000 of them at most, so these are broadcast.
    common = lines.groupBy("h", "g").agg(F.count("*").alias("n")).filter((F.col("n") >= 1000) & (F.col("n") * 2000 >= total))
    hot = F.broadcast(materialize(keepers.join(common, ["h", "g"], "left_semi"), "hot"))
    cold = lines.join(hot, ["h", "g"], "left_anti").join(keepers.hint("merge"), ["h", "g"])
    dropped = (
        cold.unionByName(lines.join(hot, ["h", "g"]))
        .filter(F.col("d") > F.col("keeper"))
        .groupBy("d", "v")
        .agg(F.sort_array(F.collect_set("pos")).alias("drop"))
    )
    out = base.withColumn("v", F.xxhash64("t")).join(dropped, ["d", "v"], "left")
    # Slices between neighbouring dropped positions: linear in the number of lines.
    out = out.select(
        "id",
        F.split("t", "\n", -1).alias("ls"),
        F.coalesce("drop", F.array().cast("array<int>")).alias("drop"),
        *[f"_keep{i}" for i in range(len(keep))],
    )
    out = out.withColumn("b", F.concat(F.array(F.lit(-1)), "drop", F.array(F.size("ls"))))
    kept = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.size("b") - 1),
            lambda i: F.slice("ls", F.get("b", i - 1) + 2, F.get("b", i) - F.get("b", i - 1) - 1),
        )
    )
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.size("drop") == 0, F.array_join("ls", "\n")).otherwise(F.array_join(kept, "\n")).alias(text_col),
        F.size("ls").cast("long").alias("n_lines"),
        F.size("drop").cast("long").alias("n_dropped"),
        *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)],
    )
