"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Items are partitioned by their number of distinct shingles.  The sketch of an item is its bottom-k
MinHash, with k set by the largest size of its class so that a text holding the threshold share of the
item's shingles must hold one of the k: search by sketch loses no pair, however long the text is.
Candidates are then verified by the share of the item's shingles (as strings) that the text holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize

#: Rows of sketches or shingles that may be broadcast (24 bytes a row, thus about 24 MB at most).
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(words: Column, lengths: list[int], one) -> Column:
    """Of each length, what ``one`` makes of the n-gram that starts at a word; nothing where there is none."""

    def of_length(n: int) -> Column:
        starting = F.transform(words, lambda _, i: one(words, i, n))
        return F.slice(starting, 1, F.greatest(F.size(words) - (n - 1), F.lit(0)))

    return F.concat(*map(of_length, lengths)) if len(lengths) > 1 else of_length(lengths[0])


def shingle_strings(words: Column, *lengths: int) -> Column:
    """Space-joined word n-grams; none of more words than there are."""
    return _shingles(words, lengths, lambda w, i, n: F.concat_ws(" ", *[F.get(w, i + j) for j in range(n)]))


def shingle_hashes(words: Column, *lengths: int) -> Column:
    return _shingles(words, lengths, lambda w, i, n: F.xxhash64(*[F.get(w, i + j) for j in range(n)]))


def _checked(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def sketches(items: DataFrame, threshold: float, step: int = 2) -> DataFrame:
    """(item, size, class, h): bottom-k MinHash of each item, k by size class ``step**class``."""
    one = items.select("item", "size", F.explode("hs").alias("h")).withColumn(
        "size_class", F.ceil(F.log(float(step), F.col("size"))).cast("int")
    )
    k = F.floor(F.lit(1 - threshold + 1e-9) * F.pow(F.lit(float(step)), F.col("size_class"))) + 1
    order = Window.partitionBy("item").orderBy(F.xxhash64("h", F.lit(7)))
    return one.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank")


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    n: int = 5,
    threshold: float = 0.8,
) -> DataFrame:
    """(id, item, shared, size): the items of which a document holds ``threshold`` or more.

    Shingles are ``n`` words of letters and digits, lower-cased; containment is over distinct shingles.
    An item below ``n`` words is one shingle of all its words.  One without a word (null or empty text) or
    with a null id is never found; documents with null or empty text hold none.  Rows with the same id
    count as one document.  Other columns are not read.
    """
    words = (
        items.filter(F.col(item_col).isNotNull())
        .select(F.col(item_col).alias("item"), words_of(F.col(item_text_col)).alias("w"))
        .withColumn("n", F.least(F.size("w"), F.lit(n)))
        .filter("n > 0")
    )
    words = materialize(words, "items")
    # n, and the fewer words of shorter items: n values at most
    lengths = sorted({n} | {r.n for r in words.select("n").distinct().collect()})
    of_length = [F.when(F.col("n") == k, F.arrays_zip(shingle_strings(F.col("w"), k).alias("gram"), shingle_hashes(F.col("w"), k).alias("h"))) for k in lengths]
    grams = words.select("item", F.explode(F.coalesce(*of_length)).alias("g")).select("item", "g.gram", "g.h").distinct()
    grams = materialize(grams, "grams")
    sized = grams.groupBy("item").agg(F.count("*").alias("size"), F.collect_set("h").alias("hs"))
    sketch = materialize(sketches(sized, threshold), "sketches")

    base = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("d"), F.col(text_col).alias("t"))
    found = (
        base.select("d", words_of(F.col("t")).alias("w"))
        .select("d", F.explode(shingle_hashes(F.col("w"), *lengths)).alias("h"))
        .join(_checked(sketch.select("h", "item"), sketch.count()), "h")
        .select("d", "item")
        .distinct()
    )
    found = materialize(found, "candidates")
    ids = found.select("d").distinct()
    held = (
        base.join(_checked(ids, found.count()), "d", "left_semi")
        .select("d", words_of(F.col("t")).alias("w"))
        .select("d", F.explode(F.array_distinct(shingle_strings(F.col("w"), *lengths))).alias("gram"))
        .join(_checked(grams.select("gram", "item"), grams.count()), "gram")
        .join(found, ["d", "item"], "left_semi")
        .groupBy("d", "item")
        .agg(F.count_distinct("gram").alias("shared"))
        .join(_checked(sized.select("item", "size"), grams.count()), "item")
        .filter(F.col("shared") >= F.lit(threshold - 1e-9) * F.col("size"))
    )
    return held.select(F.col("d").alias(id_col), F.col("item").alias(item_col), "shared", "size")


def decontaminate(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """One row per input row: id, n_items, item_ids (ascending, comma-joined), contaminated.

    Ids come back as they are, nulls too (never contaminated); see ``contained_items`` for the rest.
    """
    id_col, item_col = kw.get("id_col", "doc_id"), kw.get("item_col", "item_id")
    hits = contained_items(docs, items, **kw).groupBy(id_col).agg(F.sort_array(F.collect_list(item_col)).alias("_found"))
    out = docs.select(id_col).join(hits, id_col, "left")
    n = F.coalesce(F.size("_found"), F.lit(0)).cast("long")
    n = F.when(F.col("_found").isNull(), F.lit(0).cast("long")).otherwise(n)
    return out.select(
        id_col,
        n.alias("n_items"),
        F.coalesce(F.array_join(F.col("_found").cast("array<string>"), ","), F.lit("")).alias("item_ids"),
        F.col("_found").isNotNull().alias("contaminated"),
    )
