import hashlib
import re

from evenkeel.llm.queries import RULES, op6_url_filter, read
from evenkeel.llm.url_filter import canonical, filter_urls


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    low = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return low, re.match(r"[^?#]*", rest[len(host) :])[0]


def canon(url):
    host, path = split(url)
    query = re.match(r"[^#?]*\?([^#]*)", url.split("://", 1)[1]) if url and "://" in url else None
    keep = sorted(p for p in (query[1] if query else "").split("&") if p and not re.match(r"(utm_[^=]*|ref)(=|$)", p))
    return re.sub(r"^www\.", "", host) + re.sub(r"(\.html)?/*$", "", path) + ("?" + "&".join(keep) if keep else "")


def verdict(url, listed):
    host, path = split(url)
    fits = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    if fits:
        h, p, v = max(fits, key=lambda r: len(r[0]) + len(r[1]))
        return host, path, h + p, v
    return host, path, None, "block" if canon(url) in listed else "allow"


def test_query(spark, sf):
    pages = [(r.page_id, r.url) for r in read(spark, sf, "pages").select("page_id", "url").collect()]
    listed = {canon(u) for _, u in pages if "://" in u and hashlib.md5(canon(u).encode()).hexdigest()[0] in "01"}
    want = sorted(str((i, *verdict(u, listed))) for i, u in pages)
    assert sorted(str((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in op6_url_filter(spark, sf).collect()) == want


URLS = [
    None, "", "no scheme/at/all", "http://", "HTTP://WWW.Example.COM/en/x.html?utm_a=1&b=2#f", "http://example.com/en/x", "http://x.net/es/",
    "http://a.org/p?ref=1", "http://a.org/p/", "http://a.org/p.html#z", "http://www.a.org/q?b=2&a=1", "http://a.org/q?a=1&b=2", "x://y://z/k\nl?m",
    "http://é.org/ü", "http://notexample.com/en/", "http://a.org/p",
]


def test_edges(spark):
    pages = spark.createDataFrame([(i % 14, u, "c") for i, u in enumerate(URLS)], "page_id long, url string, canon string")
    bad = spark.createDataFrame([("http://a.org/p",), ("http://a.org/q?a=1&b=2",), (None,), ("junk",)], "url string")
    got = filter_urls(pages, bad, RULES).collect()
    listed = {canon("http://a.org/p"), canon("http://a.org/q?a=1&b=2")}
    assert sorted(str((r.host, r.path, r.rule, r.verdict)) for r in got) == sorted(str(verdict(u, listed)) for u in URLS)
    assert all(r.possible for r in got if r.listed)  # no false negative
    assert filter_urls(pages.limit(0), bad, RULES).collect() == []
    assert not any(r.listed for r in filter_urls(pages, bad.limit(0), RULES).collect())


def test_filter_has_false_positives_removed(spark):
    many = spark.range(3000).selectExpr("id page_id", "concat('http://h.org/', id) url")
    out = filter_urls(many, many.filter("page_id % 7 = 0"), [], bits_per_url=4)
    rows = out.collect()
    assert {r.page_id for r in rows if r.listed} == {i for i in range(3000) if i % 7 == 0}
    assert sum(r.possible for r in rows) > sum(r.listed for r in rows)
    assert many.limit(1).select(canonical(many.url)).first()[0] == "h.org/0"


def test_filter_too_large_to_broadcast(spark, monkeypatch):
    from evenkeel.llm import url_filter

    monkeypatch.setattr(url_filter, "BROADCAST_BLOCKS", 0)
    urls = [*URLS, *["http://a.org/p"] * 300, *[None] * 300]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    bad = spark.createDataFrame([("http://a.org/p",), (None,)], "url string")
    got = filter_urls(pages, bad, RULES)
    want = sorted(str((i, *verdict(u, {canon("http://a.org/p")}))) for i, u in enumerate(urls))
    assert sorted(str((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in got.collect()) == want
