"""Searches on the cohort."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..cohort import order_cohort
from ..functions.columns import rounded
from ..operators import geometry as G
from ..operators import search as S
from ..operators import study as Y
from ..operators.batch_fit import utilities
from ..operators.splits import stratified_split
from ..sources.tabular import materialize
from .geometry_queries import _M, _MEAN
from .registry import COHORT, LONG, query

POWERS = [3, 1 / 3, 5, 1 / 5]


ATTRS, CATS, NUMS = ["seg", "bal_hi"], ["prio"], ["price", "acctbal"]


def _search(df, **options) -> S.Mitigation:
    return S.Mitigation(df, ATTRS, CATS, NUMS, "y", POWERS, **{"mode": "next"} | options)


@query()
def search_categorical(spark, sf):
    """Every merge of the chain down to one category, with its distance, loss of information and verdict."""
    m = _search(order_cohort(spark, sf), phi=0.5)
    chain = S.merge_chain(m.cell, "prio", "seg")
    found = m.measured("prio", "seg", [{"merge": x} if left > 1 else "dropped" for x, left in chain])
    rows = [(i, json.dumps(c, sort_keys=True), left, d, loss, ok) for i, ((_, left), (c, d, loss, _, ok, _)) in enumerate(zip(chain, found, strict=True))]
    return rounded(spark.createDataFrame(rows, "step int, change string, left int, d double, loss double, accepted boolean"))


#: The ninth power leaves the 32-bit float range, so that it stands for a drop.
_STREAM = [3.0, 9.0, 1 / 3, 5.0, 1 / 5]
_POW = " UNION ALL ".join(
    f"SELECT {i} AS i, {p == 9.0} AS dropped, CAST({p!r} AS DOUBLE) AS power, seg, sign(price) * pow(abs(price), CAST({p!r} AS DOUBLE)) AS x FROM cohort" for i, p in enumerate(_STREAM)
)


@query(
    f"""WITH {COHORT}, px AS ({_POW}), m AS (SELECT i, dropped, power, seg, avg(x) AS m, min(x) AS lo, max(x) AS hi FROM px GROUP BY ALL),
e AS (SELECT avg(abs(a.m - b.m) / (greatest(a.hi, b.hi) - least(a.lo, b.lo))) * 0.9 AS epsilon FROM
 (SELECT seg, avg(price) AS m, min(price) AS lo, max(price) AS hi FROM cohort GROUP BY 1) a JOIN (SELECT seg, avg(price) AS m, min(price) AS lo, max(price) AS hi FROM cohort GROUP BY 1) b ON a.seg < b.seg),
g AS (SELECT a.i, a.dropped, a.power, avg(abs(a.m - b.m) / (greatest(a.hi, b.hi) - least(a.lo, b.lo))) AS g FROM m a JOIN m b ON a.i = b.i AND a.seg < b.seg GROUP BY ALL),
v AS (SELECT i, dropped, power, CASE WHEN dropped THEN 0 ELSE g END AS d, NOT dropped AND g < epsilon AS ok FROM g, e)
SELECT CAST(i AS INT) AS i, round(power, 6) AS power, dropped, round(1000 * d, 6) AS d1000, coalesce(i = (SELECT min(i) FROM v WHERE ok), false) AS accepted FROM v"""
)
def search_numerical(spark, sf):
    """The powers of a feature in stream order, as the search measures them: by the distance to the origin, a drop where it overflows."""
    m = S.Mitigation(order_cohort(spark, sf), ["seg"], [], ["price"], "y", _STREAM, share=0.9, phi=0.5)
    changes = ["dropped" if m._overflows("price", p) else {"power": p} for p in _STREAM]
    found = m.measured("price", "seg", changes)
    first = next((i for i, x in enumerate(found) if x[4]), None)
    assert (None if first is None else changes[first]) == (m._search("price", "seg") or (None,))[0]
    rows = [(i, p, c == "dropped", 1000 * d, i == first) for i, (p, (c, d, *_)) in enumerate(zip(_STREAM, found, strict=True))]
    return rounded(spark.createDataFrame(rows, "i int, power double, dropped boolean, d1000 double, accepted boolean"))


@query()
def mitigate_step(spark, sf):
    m = _search(order_cohort(spark, sf))
    m.run()
    return rounded(m.trace_table().withColumn("ended", F.lit(m.status)))


@query(
    f"""WITH {LONG}, {_M}, g AS (SELECT attr, grp_a, grp_b, feature, g FROM num WHERE attr = 'seg'), {_MEAN},
o AS (SELECT d, row_number() OVER (ORDER BY d DESC) AS i FROM dist WHERE node_b = 'origin'), b AS (SELECT max(CASE WHEN i = 1 THEN d END) AS before, max(CASE WHEN i = 2 THEN d END) AS after FROM o)
SELECT CAST(0.5 AS DOUBLE) AS phi, CASE WHEN before <= 0 OR (before - after) / before < 0.1 THEN CAST(0.475 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS next_phi FROM b"""
)
def adaptive_phi(spark, sf):
    d = G.distances(G.div_num(G.moments(order_cohort(spark, sf), ["seg"], ["price", "acctbal", "avg_disc"])), ["attr"])
    worst = [r.d for r in d.filter(F.col("node_b") == G.ORIGIN).orderBy(F.desc("d")).limit(2).collect()]  # a top-k report
    return rounded(spark.createDataFrame([(0.5, S.adaptive_phi(0.5, *worst))], "phi double, next_phi double"))


def _newton(steps: int = 8, reg: float = 1e-3) -> str:
    """A logistic fit of two standardised columns a and b of table z for each candidate, by Newton steps."""
    out = ["b0 AS (SELECT candidate, CAST(0 AS DOUBLE) AS w0, CAST(0 AS DOUBLE) AS w1, CAST(0 AS DOUBLE) AS w2 FROM st)"]
    det = "(h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02))"
    for k in range(steps):
        out.append(f"p{k} AS (SELECT z.*, w1, w2, w0, 1 / (1 + exp(-(w0 + w1 * a + w2 * b))) AS p FROM z JOIN b{k} USING (candidate) WHERE split = 'train')")
        out.append(
            f"s{k} AS (SELECT candidate, any_value(w0) AS w0, any_value(w1) AS w1, any_value(w2) AS w2, avg(p - y) AS g0, avg((p - y) * a) + {reg} * any_value(w1) AS g1, avg((p - y) * b) + {reg} * any_value(w2) AS g2,"
            f" avg(p * (1 - p)) AS h00, avg(p * (1 - p) * a) AS h01, avg(p * (1 - p) * b) AS h02, avg(p * (1 - p) * a * a) + {reg} AS h11, avg(p * (1 - p) * a * b) AS h12, avg(p * (1 - p) * b * b) + {reg} AS h22 FROM p{k} GROUP BY 1)"
        )
        out.append(
            f"b{k + 1} AS (SELECT candidate, w0 - (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / {det} AS w0,"
            f" w1 - (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / {det} AS w1,"
            f" w2 - (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / {det} AS w2 FROM s{k})"
        )
    return ", ".join(out)


@query(
    f"""WITH {COHORT}, d AS (SELECT 'acctbal^' || e AS candidate, CASE WHEN survey_year <= 1997 THEN 'train' ELSE 'val' END AS split, y, sign(acctbal) * pow(abs(acctbal), e) AS x, p1
 FROM cohort, (VALUES (1), (3), (5)) v(e) WHERE survey_year <= 1997 OR survey_year = 1999),
st AS (SELECT candidate, avg(x) AS mx, stddev_samp(x) AS sx, avg(p1) AS mp, stddev_samp(p1) AS sp FROM d WHERE split = 'train' GROUP BY 1),
z AS (SELECT candidate, split, y, (x - mx) / sx AS a, (p1 - mp) / sp AS b FROM d JOIN st USING (candidate)), {_newton()},
q AS (SELECT z.candidate, y, round(w0 + w1 * a + w2 * b, 9) AS s FROM z JOIN b8 USING (candidate) WHERE split = 'val'),
k AS (SELECT candidate, s, sum(y) AS pos, sum(1 - y) AS neg FROM q GROUP BY 1, 2),
c AS (SELECT *, sum(neg) OVER (PARTITION BY candidate ORDER BY s) - neg AS below FROM k)
SELECT candidate, round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auroc, 'VALID' AS status FROM c GROUP BY 1"""
)
def candidate_utility(spark, sf):
    """Each power of a feature through one batch of fits on the years up to 1997, measured on 1999."""
    year = F.col("survey_year")
    split = F.when(year <= 1997, "train").when(year == 1999, "val")
    parts = order_cohort(spark, sf).withColumn("split", split).filter("split is not null")
    states = {f"acctbal^{p}": {"acctbal": {"power": float(p)}} for p in (1, 3, 5)}
    found = utilities(parts, states, [], ["acctbal", "p1"], ["y", "split"], "y", metric="auroc")
    return rounded(spark.createDataFrame([(c, u, status) for c, (u, status) in found.items()], "candidate string, auroc double, status string"))


def _enhanced(spark, sf):
    keep = ["record_key", "y", *ATTRS, "split"]
    parts = materialize(stratified_split(order_cohort(spark, sf), ["y"], "record_key").select(*keep, *CATS, *NUMS), "split")
    m = _search(parts.filter("split = 'train'"))
    m.run()
    rows, best = Y.enhance_step(parts, m, CATS, NUMS, keep, "y", POWERS[:2], slack=0.01)
    return spark.createDataFrame([(0, *r) for r in rows], Y.AUDIT), best


@query()
def enhance_step(spark, sf):
    """The accepted change of the best gain in utility, if any."""
    return rounded(_enhanced(spark, sf)[0].filter("reason = 'accepted'"))


@query()
def candidate_audit(spark, sf):
    return rounded(_enhanced(spark, sf)[0])
