"""Secret scans with multipart credential linking.

Strong patterns are reported as they are.  Weak candidates (long mixed strings, URLs) are reported only
when complementary parts lie within one scope of them.  The interval join of access identifiers, secrets
and endpoints links each span to the nearest of the other part: spans of one part are disjoint or nested
at their start, so the nearest is the last that begins before it or the first that begins after it, which
running windows over a document's spans give without emitting a pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed patterns of the base kinds, in listed order.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # the first AKIA of a run takes the whole run, so this is "AKIA[A-Z0-9]+ of 18 or more"
HEX = r"[0-9a-f]{16,}"
#: Weak candidates of the linking step.
WEAK = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])"
ENDPOINT = r"(?:https?|postgres|postgresql|mysql|mongodb|redis|amqp|ftp)://[^\s\"'<>]+"
KINDS = ("assign", "access", "hex", "secret", "endpoint")


def _pieces(text: Column, kind: int, pattern: str, group: str = "") -> Column:
    """array<struct<kind, i, gap, len, ok>>: gap is what lies between the match before and this one.

    ``split`` and ``regexp_extract_all`` walk the same matches, so gaps and lengths give positions.
    """
    p = F.lit(pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    gaps = F.split(text, pattern, -1)
    ok = F.lit(True)
    cols = [found, gaps]
    if group:
        cols.append(F.regexp_extract_all(text, p, F.lit(2)))
    zipped = F.arrays_zip(*[c.alias(n) for c, n in zip(cols, ("m", "g", "v"), strict=False)])

    def one(x: Column, i: Column) -> Column:
        good = F.length(x["v"]) >= 12 if group else ok
        if kind == 3:  # letters of both cases and digits, or a mixture with + / _
            good = x["m"].rlike("[0-9]") & x["m"].rlike("[A-Z]") & x["m"].rlike("[a-z]")
        return F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("len"), F.coalesce(good, F.lit(False)).alias("ok")
        )

    # gaps has one more element than found; the last has no match beside it.
    rows = F.filter(F.transform(zipped, one), lambda s: s["len"].isNotNull())
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,len:int,ok:boolean>>")
    return F.when(text.rlike(pattern), rows).otherwise(none)


def _nearest(rows: DataFrame, key: list[str], parts: dict[str, Column]) -> DataFrame:
    """Adds for each part the nearest other span of it: struct<distance, start, end>, null without one.

    The distance of two spans is the number of code points between them, 0 if they meet or overlap; of
    equally near ones the earlier wins.
    """
    span = F.struct(F.col("end"), F.col("start"))
    ahead = Window.partitionBy(*key).orderBy("start", "kind")
    back = Window.partitionBy(*key).orderBy(F.desc("start"), F.desc("kind"))
    before, after = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (ahead, back))
    # of those that begin before, the one that ends last; of those that begin after, the first
    rows = rows.withColumns({f"{n}_b": F.max(F.when(c, span)).over(before) for n, c in parts.items()})
    rows = rows.withColumns({f"{n}_a": F.min(F.when(c, F.struct("start", "end"))).over(after) for n, c in parts.items()})

    def one(n: str) -> Column:
        b, a = F.col(f"{n}_b"), F.col(f"{n}_a")
        left = F.when(b.isNotNull(), F.struct(F.greatest(F.lit(0), F.col("start") - b["end"]).alias("distance"), b["start"].alias("start"), b["end"].alias("end")))
        right = F.when(a.isNotNull(), F.struct(F.greatest(F.lit(0), a["start"] - F.col("end")).alias("distance"), a["start"].alias("start"), a["end"].alias("end")))
        return F.array_min(F.filter(F.array(left, right), lambda x: x.isNotNull()))

    return rows.withColumns({n: one(n) for n in parts}).drop(*[f"{n}_{x}" for n in parts for x in "ab"])


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 400
) -> DataFrame:
    """(row, id, start, end, kind, kind_no, access, secret): every reported span, positions in code points, end
    exclusive, with the start of the access identifier and of the secret it is linked to.

    Base kinds are always reported.  A ``secret`` (20 or more characters with digits and letters of both
    cases) is reported where an access identifier lies within ``scope`` code points of it, counted between
    the ends that face each other; an ``endpoint`` where both an access identifier and a secret (assigned,
    hexadecimal or weak) do; a weak secret inside a base span is not repeated.  ``access`` and ``secret``
    are those of the nearest such span within the scope, the earlier of two, or null; a span is not its own
    link.  Null text is empty.  Each document also gives one row of kind null (kind_no -1), so that none is
    lost.  Rows that repeat an id with the same text are one document, with another text two.  Other
    columns are not read.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("d"), t.alias("t"))
    anchor = F.array(F.struct(*[F.lit(v).alias(n) for n, v in (("kind", -1), ("i", 0), ("gap", 0), ("len", 0), ("ok", True))]))
    pieces = F.concat(
        anchor,
        _pieces(F.col("t"), 0, ASSIGN, "v"),
        _pieces(F.col("t"), 1, ACCESS),
        _pieces(F.col("t"), 2, HEX),
        # a weak part needs an access identifier in its document
        F.when(F.col("t").rlike(ACCESS), F.concat(_pieces(F.col("t"), 3, WEAK), _pieces(F.col("t"), 4, ENDPOINT))).otherwise(
            F.array().cast("array<struct<kind:int,i:int,gap:int,len:int,ok:boolean>>")
        ),
    )
    # The hash of a text is taken once, before its pieces are spread out.
    rows = base.select("d", F.xxhash64("t").alias("v"), pieces.alias("ps")).select("d", "v", F.explode("ps").alias("s")).select("d", "v", "s.*")
    key = ["d", "v"]
    # A row that comes twice yields the same pieces twice: one is enough.
    rows = rows.groupBy(*key, "kind", "i").agg(F.max("gap").alias("gap"), F.max("len").alias("len"), F.max("ok").alias("ok"))
    run = Window.partitionBy(*key, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(run)).withColumn("start", F.col("end") - F.col("len"))
    rows = rows.filter("ok")

    upto = Window.partitionBy(*key).orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    inside = F.coalesce(F.max(F.when(F.col("kind").between(0, 2), F.col("end"))).over(upto) > F.col("start"), F.lit(False))
    rows = rows.withColumn("inside", inside).filter((F.col("kind") != 3) | ~F.col("inside"))
    onward = Window.partitionBy(*key).orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)

    def overlaps(kind: int) -> Column:  # spans of a kind are disjoint
        back, on = F.max(F.when(F.col("kind") == kind, F.col("end"))).over(upto), F.min(F.when(F.col("kind") == kind, F.col("start"))).over(onward)
        return F.coalesce(back > F.col("start"), F.lit(False)) | F.coalesce(on < F.col("end"), F.lit(False))

    some = F.col("kind").isin(0, 2, 3)
    rows = rows.withColumns({"on_access": some & overlaps(1), "on_endpoint": F.col("kind").between(0, 3) & overlaps(4)})
    free = ~F.col("on_endpoint")
    parts = {"to_access": F.col("kind") == 1, "to_free": (F.col("kind") == 1) & free, "to_secret": some & free & ~F.col("on_access")}
    rows = _nearest(rows, key, parts)
    to = {c: F.when(F.col(c)["distance"] <= scope, F.col(c)["start"]) for c in parts}
    access, secret = F.when(F.col("kind") == 4, to["to_free"]).when(~F.col("on_access"), to["to_access"]), to["to_secret"]
    rows = rows.withColumns({"access": access, "secret": secret}).filter(
        (F.col("kind") <= 2)
        | ((F.col("kind") == 3) & F.col("access").isNotNull())
        | (F.col("access").isNotNull() & F.col("secret").isNotNull())
    )
    names = F.array(*[F.lit(k) for k in KINDS])
    real = F.col("kind") >= 0
    return rows.select(
        F.col("d").alias(id_col),
        F.col("v").alias("version"),
        F.col("start"),
        F.col("end"),
        F.get(names, F.when(real, F.col("kind"))).alias("kind"),
        F.col("kind").alias("kind_no"),
        F.when(real, F.col("access")).alias("access"),
        F.when(real, F.col("secret")).alias("secret"),
    )
