"""The derived cohort on layouts that add the same lines in different orders."""

import math
import os
from fractions import Fraction

import duckdb
import pytest

import __spark_entry__
from evenkeel.cohort import order_cohort, table


@pytest.fixture(scope="session")
def turned(spark, sf, tmp_path_factory):
    """The tables with the lines in descending order, over several files."""
    at = str(tmp_path_factory.mktemp("turned"))
    for name in ("orders", "customer", "nation"):
        os.symlink(f"{sf}/{name}.parquet", f"{at}/{name}.parquet")
    table(spark, sf, "lineitem").orderBy("l_partkey", "l_discount").write.parquet(f"{at}/lineitem.parquet")
    return at


def same_as_sql(spark, name, at, lines):
    con = duckdb.connect()
    for t in ("orders", "customer", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{lines}' ORDER BY l_orderkey, l_discount DESC, l_linenumber")
    got = __spark_entry__.queries()[name](spark, at)
    sql = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in got.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    key = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    assert key(got.collect()) == key(sql)


def test_mean_discount_has_no_order(spark, sf, turned):
    a, b = (order_cohort(spark, at).select("record_key", "avg_disc") for at in (sf, turned))
    assert a.exceptAll(b).isEmpty() and a.count() == b.count()
    # the mean of equal discounts is that discount
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg({"l_discount": "min", "*": "count"}).toDF("record_key", "n", "least")
    most = table(spark, sf, "lineitem").groupBy("l_orderkey").agg({"l_discount": "max"}).toDF("record_key", "most")
    assert a.join(lines, "record_key").join(most, "record_key").filter("least = most and avg_disc <> least").isEmpty()


def test_geometry_diagnostics_on_other_orders(spark, sf, turned):
    same_as_sql(spark, "geometry_diagnostics", turned, f"{sf}/lineitem.parquet")


def test_median_impute_at_a_bound(spark, sf, tmp_path):
    """Added in ascending order these four discounts have a mean above 0.08, in descending order 0.08."""
    for name in ("orders", "customer", "nation"):
        os.symlink(f"{sf}/{name}.parquet", tmp_path / f"{name}.parquet")
    odd, even = "array(0.05D, 0.07D, 0.1D, 0.1D)", "array(0.03D, 0.03D, 0.03D, 0.03D)"
    discounts = f"posexplode(if(o_orderkey % 3 = 0, {even}, {odd})) AS (l_linenumber, l_discount)"
    lines = table(spark, sf, "orders").selectExpr("o_orderkey AS l_orderkey", discounts)
    lines.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    same_as_sql(spark, "median_impute", str(tmp_path), f"{tmp_path}/lineitem.parquet/*.parquet")


def test_qcut_bins_on_other_orders(spark, sf, turned):
    same_as_sql(spark, "qcut_bins", turned, f"{sf}/lineitem.parquet")


def test_select_roles_on_other_orders(spark, sf, turned):
    same_as_sql(spark, "select_roles", turned, f"{sf}/lineitem.parquet")


def test_validity_check_on_other_orders(spark, sf, turned):
    same_as_sql(spark, "validity_check", turned, f"{sf}/lineitem.parquet")


@pytest.fixture(scope="session")
def odd(spark, sf, tmp_path_factory):
    """Orders with discounts of more than six decimals, from a million on, null or not finite."""
    at = str(tmp_path_factory.mktemp("odd"))
    for name in ("orders", "customer", "nation"):
        os.symlink(f"{sf}/{name}.parquet", f"{at}/{name}.parquet")
    kinds = [
        "array(0.0800004D, 0.0800004D)",
        "array(o_orderkey * 1e-10, o_orderkey * 3e-10, 0.03D, 0.0712345678912D)",
        "array(2.5e6, 1e15, 0.05D, null)",
        "array(double('Infinity'), 0.04D)",
        "array(double('NaN'), 0.04D, double('-Infinity'))",
        "array(double(null), double(null))",
    ]
    which = " ".join(f"WHEN {i} THEN {k}" for i, k in enumerate(kinds[2:], 100))
    discounts = f"posexplode(CASE o_orderkey {which} ELSE if(o_orderkey % 2 = 0, {kinds[0]}, {kinds[1]}) END) AS (l_linenumber, l_discount)"
    lines = table(spark, sf, "orders").selectExpr("o_orderkey AS l_orderkey", discounts)
    lines.repartition(3).write.parquet(f"{at}/lineitem.parquet")
    return at


def same_as_sql_with_nan(spark, name, at):
    """The query's rows, and that they are those of its SQL, NaN being like NaN."""
    con = duckdb.connect()
    for t in ("orders", "customer", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{at}/lineitem.parquet/*.parquet'")
    got = __spark_entry__.queries()[name](spark, at)
    sql = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in got.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    rows = got.collect()
    assert sorted(repr(tuple(r)) for r in rows) == sorted(repr(r) for r in sql)
    return rows


def test_select_roles_of_odd_discounts(spark, odd):
    """No digit of a discount is cut, and none that is not finite is left out."""
    lines = {}
    for k, x in table(spark, odd, "lineitem").select("l_orderkey", "l_discount").collect():
        lines.setdefault(k, []).append(x)
    got = {r["record_key"]: r for r in order_cohort(spark, odd).select("record_key", "n_lines", "avg_disc").collect()}
    for k, r in got.items():
        xs = [x for x in lines[k] if x is not None]
        assert r["n_lines"] == len(lines[k])
        if not xs:
            assert r["avg_disc"] is None
        elif all(map(math.isfinite, xs)):
            assert r["avg_disc"] == pytest.approx(float(sum(map(Fraction, xs)) / len(xs)), rel=1e-15)
        else:
            assert repr(r["avg_disc"]) == repr(sum(xs) / len(xs))
    same_as_sql_with_nan(spark, "select_roles", odd)


def test_validity_check_of_odd_discounts(spark, odd):
    """The SQL counts infinite means as the query does; means that differ below a millionth stay apart."""
    got = {r["feature"]: r for r in same_as_sql_with_nan(spark, "validity_check", odd)}
    assert (got["avg_disc"]["n_inf"], got["avg_disc"]["status"]) == (1, "NULLS")
    assert got["avg_disc"]["n_distinct"] > 500


def test_validity_check_of_an_infinite_price(spark, sf, tmp_path):
    for name in ("lineitem", "customer", "nation"):
        os.symlink(f"{sf}/{name}.parquet", tmp_path / f"{name}.parquet")
    price = "if(o_orderkey = 5, double('Infinity'), o_totalprice) AS o_totalprice"
    table(spark, sf, "orders").selectExpr("* EXCEPT (o_totalprice)", price).coalesce(1).write.parquet(str(tmp_path / "orders"))
    (part,) = (tmp_path / "orders").glob("*.parquet")
    part.rename(tmp_path / "orders.parquet")
    same_as_sql(spark, "validity_check", str(tmp_path), f"{sf}/lineitem.parquet")


def test_median_impute_just_above_the_bound(spark, odd):
    """A mean of 0.0800004 is out of the range up to 0.08, and gets the median of the valid rows."""
    rows = {r["record_key"]: r["avg_disc_imp"] for r in same_as_sql_with_nan(spark, "median_impute", odd)}
    assert 0.0 < rows[2] < 0.08 and {rows[k] for k in range(100, 104)} == {rows[2]}


def test_qcut_bins_of_discounts_that_differ_below_a_millionth(spark, sf, tmp_path):
    """Ten bins of about as many fitted rows each, though the means are all 0.05 to six decimals."""
    for name in ("orders", "customer", "nation"):
        os.symlink(f"{sf}/{name}.parquet", tmp_path / f"{name}.parquet")
    lines = table(spark, sf, "orders").selectExpr("o_orderkey AS l_orderkey", "1 AS l_linenumber", "0.05D + (o_orderkey * 7919) % 1500 * 1e-10 AS l_discount")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    sizes = [0] * 10
    for r in same_as_sql_with_nan(spark, "qcut_bins", str(tmp_path)):
        sizes[r["avg_disc_bin"]] += 1
    assert min(sizes) > 100
