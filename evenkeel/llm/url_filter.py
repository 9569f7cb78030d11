"""URL filters: host and path rules, then a blocked Bloom filter and an exact hash join.

The filter is the split-block kind: a hash names one block of eight 32-bit lanes, and a second hash sets
one bit in each lane.  It is a table (block, eight lanes), built by ``bit_or`` per block and probed by a
join on the block.  Pages whose eight bits are all set are possible hits; a hash join with the listed
URLs removes the false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .line_dedup import LOWER, UPPER
from .scratch import materialize

LANES = 8
#: Blocks that may be broadcast: 40 bytes each, thus about 40 MB at most.
BROADCAST_BLOCKS = 1_000_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without ``.html`` and ``/`` at its end, query without tracking keys."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(path_of(url), r"(\.html)?/*$", "")
    keep = F.filter(F.split(query_of(url), "&"), lambda p: ~p.rlike("^(utm_[^=]*|ref)(=|$)") & (p != ""))
    query = F.array_join(F.array_sort(keep), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def rule_verdict(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, says in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks)).cast("long")


def _masks(url: Column) -> list[Column]:
    bits = F.xxhash64(F.lit(1), url)
    return [
        F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(bits, 5 * i).bitwiseAND(31).cast("int"))
        for i in range(LANES)
    ]


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, l0..l7) of a table of distinct ``canon``."""
    return (
        listed.select(_block(F.col("canon"), blocks).alias("block"), *[m.alias(f"m{i}") for i, m in enumerate(_masks(F.col("canon")))])
        .groupBy("block")
        .agg(*[F.bit_or(f"m{i}").alias(f"l{i}") for i in range(LANES)])
    )


def filter_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: list[tuple[str, str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    listed_url_col: str = "url",
    bits_per_url: int = 16,
) -> DataFrame:
    """One row per page: id, host, path, canon, rule, possible (passed the filter), listed, verdict.

    ``listed`` is a table of URLs in any form; its nulls and URLs without ``://`` are left out.  A page
    without host (null, empty or odd URL) fits no rule and is allowed.  Repeated pages are judged each.
    A rule is (host, path, allow or block); it fits the host and its subdomains where the path starts with
    the rule's, and the longest wins.  Without a rule a page is blocked if its canonical URL is listed.
    Other columns are not read; empty tables are fine on either side.
    """
    names = (
        listed.filter(F.col(listed_url_col).contains("://"))
        .select(canonical(F.col(listed_url_col)).alias("canon"))
        .distinct()
    )
    names = materialize(names, "listed")
    blocks = max(1, -(-names.count() * bits_per_url // (32 * LANES)))
    bloom = bloom_filter(names, blocks)
    bloom = F.broadcast(bloom) if blocks <= BROADCAST_BLOCKS else bloom

    url = F.col("u")
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("u"))
    base = base.select("id", host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canon"))
    rule, verdict = rule_verdict(F.col("host"), F.col("path"), rules)
    base = base.withColumn("rule", rule).withColumn("ruled", verdict)
    # a page without host asks no block; it has a number below 0 of its own, so that such pages do not meet in one task
    nowhere = -1 - F.pmod(F.xxhash64("id", "path"), F.lit(1 << 20))
    base = base.withColumn("block", F.when(F.col("canon") != "", _block(F.col("canon"), blocks)).otherwise(nowhere))
    probed = base.join(bloom, "block", "left")
    hit = F.coalesce(
        F.expr(" AND ".join(f"(l{i} & m{i}) = m{i}" for i in range(LANES))),
        F.lit(False),
    )
    probed = probed.withColumns({f"m{i}": m for i, m in enumerate(_masks(F.col("canon")))}).withColumn("possible", hit)
    probed = materialize(probed.select("id", "host", "path", "canon", "rule", "ruled", "possible"), "probed")
    # Only possible hits carry a key into the exact join; the rest match nothing and stay where they are.  The list's
    # names are distinct and the join keeps the left side, so that AQE may split the pages of one hot URL.
    names = names.select(F.col("canon").alias("name"), F.lit(True).alias("yes")).hint("shuffle_hash")
    sure = probed.filter(~F.col("possible")).withColumn("listed", F.lit(False))
    maybe = probed.filter("possible").join(names, F.col("canon") == F.col("name"), "left")
    maybe = maybe.withColumn("listed", F.coalesce("yes", F.lit(False)))
    cols = ["id", "host", "path", "canon", "rule", "ruled", "possible", "listed"]
    both = maybe.select(cols).unionByName(sure.select(cols))
    return both.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        "canon",
        "rule",
        "possible",
        "listed",
        F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
    )
