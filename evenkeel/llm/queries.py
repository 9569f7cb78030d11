"""Registered queries of the pipeline operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import decontaminate
from .language_id import detect_languages
from .lexical import search
from .line_dedup import line_dedup
from .packing import pack_documents
from .prefix_trie import prefix_trie
from .quality import apply_rules, score_documents
from .secrets import KINDS, scan_secrets
from .sentencepiece_codec import decode_documents, encode_documents
from .sharding import shard_documents
from .simhash import near_duplicates
from .token_files import read_token_files, token_folder, write_token_files
from .url_filter import canonical, filter_urls

#: Fixed rules: host, path, verdict.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_languages(read(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"), 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = read(spark, sf_dir, "labels").filter("quality = 1")
    return apply_rules(score_documents(read(spark, sf_dir, "documents"), good)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    # The list: an eighth of all canonical URLs, by hash; their pages are blocked under every form of the URL.
    listed = F.substring(F.md5(canonical(F.col("url"))), 1, 1).isin("0", "1")
    out = filter_urls(pages, pages.filter(listed), RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", "canon", "listed")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, model = read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model")
    back = decode_documents(encode_documents(docs, model), model)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        F.crc32(F.array_join("ids", ",")).alias("ids_crc32"),
        F.crc32("text").alias("text_crc32"),
    )


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = scan_secrets(read(spark, sf_dir, "documents"))

    def joined(most: int) -> Column:
        one = F.filter("spans", lambda s: (s["kind_no"] >= 0) & (s["kind_no"] <= most))
        return F.array_join(F.transform(one, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: int) -> Column:
        return F.count_if(F.col("kind_no") == kind)

    grouped = spans.groupBy("doc_id", "version").agg(
        *[count(i).alias(f"n_{KINDS[i]}") for i in range(3)],
        F.sort_array(F.collect_list(F.struct("start", "kind_no", "end", "kind", "access", "secret"))).alias("spans"),
    )
    # kind:start of each linked span, then the starts of its access identifier and secret
    linked = F.filter("spans", lambda s: s["access"].isNotNull() | s["secret"].isNotNull())
    to = [lambda s, c=c: F.coalesce(s[c].cast("string"), F.lit("")) for c in ("access", "secret")]
    links = F.array_join(F.transform(linked, lambda s: F.concat_ws(":", s["kind"], s["start"], to[0](s), to[1](s))), ",")
    return grouped.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(2), 256).alias("base_sha256"), joined(9).alias("spans"), links.alias("links")
    )


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_files(
        read(spark, sf_dir, "documents"), token_folder(spark), tokenizer_file("byte_bpe_50k.json")
    )
    return read_token_files(manifest).select("doc_id", "start", F.size("ids").cast("long").alias("n_tokens"), "ids_crc32")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_decontaminate, op3_language_id, op4_sharding, op5_quality,
        op6_url_filter, op7_sentencepiece, op8_secrets, op9_token_files, op10_simhash,
        op11_prefix_trie, op12_packing, op13_lexical_search,
    )
}

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_RULES = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{}}'".replace("{}", h + p + ":" + v)
    for h, p, v in sorted(RULES, key=lambda r: (-len(r[0]) - len(r[1]), r))
)

_TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: The register of CRC-32 after the digits of c.
_CRC32 = (
    "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda r, x: "
    "list_reduce([xor(r, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1))))"
)

ORACLE: dict[str, str] = {
    "op1_line_dedup": f"""
WITH l AS (
  SELECT doc_id, i, ls[i] AS line,
         translate(trim(ls[i], {_BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
k AS (SELECT k, min(doc_id) AS keeper FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT l.*, k.keeper IS NOT NULL AND l.doc_id > k.keeper AS gone FROM l LEFT JOIN k USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op2_decontaminate": """
WITH s AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, n, array_to_string(w[j:j + n - 1], ' ') AS gram
      FROM (SELECT item_id, w, least(len(w), 5) AS n, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS j FROM s WHERE len(w) > 0)),
z AS (SELECT item_id, count(*) AS size FROM i GROUP BY item_id),
d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[j:j + n - 1], ' ') AS gram
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS j FROM d, (SELECT DISTINCT n FROM i))),
h AS (SELECT doc_id, item_id FROM g JOIN i USING (gram) JOIN z USING (item_id)
      GROUP BY doc_id, item_id, size HAVING count(*) >= 0.8 * size - 1e-9),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS item_ids FROM h GROUP BY doc_id)
SELECT doc_id, coalesce(n_items, 0) AS n_items, coalesce(item_ids, '') AS item_ids, n_items IS NOT NULL AS contaminated
FROM documents LEFT JOIN n USING (doc_id)""",
    "op6_url_filter": f"""
WITH p AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's')) AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*[^?#]*\\?([^#]*)', 1, 's') AS q
  FROM pages),
c AS (
  SELECT page_id, host, path, regexp_replace(host, '^www\\.', '') || regexp_replace(path, '(\\.html)?/*$', '')
         || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(list_sort(kept), '&') ELSE '' END AS canon
  FROM (SELECT *, list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref)(=|$)')) AS kept FROM p)),
b AS (SELECT DISTINCT canon FROM c WHERE canon <> '' AND substr(md5(canon), 1, 1) IN ('0', '1')),
r AS (SELECT c.*, b.canon IS NOT NULL AS listed, CASE {_RULES} END AS hit FROM c LEFT JOIN b USING (canon))
SELECT page_id, host, path, regexp_replace(hit, ':.*', '') AS rule,
       coalesce(regexp_extract(hit, ':(.*)', 1), CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, canon, listed
FROM r""",
    "op11_prefix_trie": f"""
WITH own AS (
  SELECT conv_id AS c, list(struct_pack(k := k, w := w) ORDER BY turn NULLS FIRST, k) AS own
  FROM (SELECT conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
               len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w
        FROM conversations WHERE conv_id IS NOT NULL)
  GROUP BY conv_id),
h AS (SELECT *, xor({_CRC32}, 4294967295) % 4 AS h FROM own),
r AS (SELECT x.c, list_concat(coalesce(y.own, [])[1:x.h], x.own[x.h + 1:]) AS turns FROM h AS x LEFT JOIN own AS y ON y.c = x.c - x.c % 20),
p AS (SELECT c, turns, d, CASE WHEN d > 0 THEN turns[d].w ELSE 0 END AS w, len(turns) AS n,
             md5(array_to_string(list_transform(turns[1:d], lambda t: t.k), ',')) AS node,
             CASE WHEN d > 0 THEN md5(array_to_string(list_transform(turns[1:d - 1], lambda t: t.k), ',')) END AS up
      FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM r)),
v AS (SELECT d AS depth, node, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
             sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = n), '')) AS ends_sha256
      FROM p GROUP BY d, node),
k AS (SELECT up AS node, depth - 1 AS depth, count(*) AS n_children FROM v WHERE up IS NOT NULL GROUP BY ALL),
f AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN k USING (node, depth)),
t AS (SELECT node, depth, count(*) FILTER (leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
      FROM (SELECT DISTINCT x.node, x.d AS depth, f.node AS below, f.depth AS below_depth, f.n_children = 0 AS leaf, (f.n_convs - 1) * f.w AS saved
            FROM p AS x JOIN p AS y ON x.c = y.c AND y.d >= x.d JOIN f ON f.node = y.node AND f.depth = y.d)
      GROUP BY node, depth)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, t.n_leaves, t.saved_tokens, f.ends_sha256
FROM f JOIN t USING (node, depth) LEFT JOIN f AS u ON u.node = f.up AND u.depth = f.depth - 1""",
    "op13_lexical_search": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}') AS w FROM documents),
s AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS term FROM benchmark),
f AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
g AS (SELECT f.*, count(*) OVER (PARTITION BY term) AS df FROM f SEMI JOIN q USING (term)),
i AS (SELECT doc_id, term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT)
             * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))) AS impact
      FROM g, s),
r AS (SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY ALL HAVING sum(impact) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM r QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50""",
}
