"""Named queries of the library with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: The derived cohort, as SQL; a mean discount sums whole millionths, and what is finer in ascending order.
COHORT = """cohort AS (
SELECT o.o_orderkey AS record_key, CAST(year(o.o_orderdate) AS INT) AS survey_year, CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS y,
 c.c_mktsegment AS seg, CASE WHEN c.c_acctbal > 5000 THEN 1 ELSE 0 END AS bal_hi, o.o_totalprice / 1000 AS w, n.n_regionkey AS stratum,
 c.c_nationkey AS psu, o.o_orderpriority AS prio, o.o_totalprice AS price, c.c_acctbal AS acctbal, l.n_lines, l.avg_disc,
 ((o.o_orderkey * 7919 + o.o_custkey * 104729) % 1000) / 1000 AS p1, ((o.o_orderkey * 31 + c.c_nationkey * 17) % 100) / 100 AS p2,
 CASE WHEN ((o.o_orderkey * 7919 + o.o_custkey * 104729) % 1000) >= 500 THEN 1 ELSE 0 END AS yhat
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines,
 CAST(sum(u) AS DOUBLE) / nullif(1000000 * count(u), 0) + coalesce(sum(r ORDER BY r) FILTER (r <> 0), 0) / nullif(count(u), 0) AS avg_disc
 FROM (SELECT l_orderkey, u, l_discount - u / CAST(1000000 AS DOUBLE) AS r FROM (SELECT l_orderkey, l_discount,
 CAST(CASE WHEN abs(l_discount) < 1000000 THEN round(l_discount * CAST(1000000 AS DOUBLE)) WHEN l_discount IS NOT NULL THEN 0 END AS BIGINT) AS u FROM lineitem))
 GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey)"""
#: The cohort with protected attributes in long form.
LONG = COHORT + """, long AS (SELECT *, 'seg' AS attr, seg AS grp FROM cohort UNION ALL SELECT *, 'bal_hi' AS attr, CAST(bal_hi AS VARCHAR) AS grp FROM cohort)"""
#: The coded survey frame.
CODED = """coded AS (SELECT l_orderkey * 10 + l_linenumber AS id, CAST(year(l_shipdate) AS INT) AS survey_year, l_linenumber AS code, l_returnflag AS route,
 l_linestatus AS prot, l_quantity AS w, l_orderkey AS orderkey FROM lineitem)"""


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name; ``sql`` may start with a comma-free CTE list after WITH."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered already")
        QUERIES[key] = f
        if sql:
            ORACLE[key] = sql
        return f

    return add


def load() -> None:
    """Import every module of queries."""
    import importlib
    import pkgutil

    from evenkeel import plans

    for m in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
        if m.endswith("_queries"):
            importlib.import_module(f"evenkeel.plans.{m}")


EXPECTED = [
    ("seg", "AUTOMOBILE"), ("seg", "BUILDING"), ("seg", "FURNITURE"), ("seg", "HOUSEHOLD"), ("seg", "MACHINERY"), ("seg", "SPACE"),
    ("bal_hi", "0"), ("bal_hi", "1"),
]
EXPECTED_SQL = "expected AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{g}')" for a, g in EXPECTED) + ") t(attr, grp))"
