"""Steps whose work may not grow faster than the rows."""

import pytest
from pyspark.sql import functions as F

from evenkeel.functions.quantiles import exact_quantiles
from evenkeel.operators import audit as A
from evenkeel.plans import learner_queries, study_queries


def test_counted_rows_have_the_same_quantiles(spark):
    rows = spark.range(5_000).selectExpr("id % 3 AS g", "CAST(pow(id % 97, 2) AS DOUBLE) AS v")
    cells = rows.groupBy("g", "v").agg(F.count("*").alias("c"))
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    a = exact_quantiles(rows, ["g"], F.col("v"), probs)
    b = exact_quantiles(cells, ["g"], F.col("v"), probs, most=10, count=F.col("c"))
    assert sorted(a.collect()) == sorted(b.collect())


def test_weights_are_read_by_their_counts(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a", 1.0)] * 5 + [(1, "b", 3.0), (1, "b", None), (1, None, -2.0), (2, "a", 0.0)], "p int, g string, w double")
    seen = []
    quantiles = A.with_quantiles
    monkeypatch.setattr(A, "with_quantiles", lambda out, rows, *more: seen.append(rows.count()) or quantiles(out, rows, *more))
    got = {(r.p, r.g, r.n): r for r in A.weight_diagnostics(df, "p", "g", "w").collect()}
    assert seen == [10]  # nine rows, each in its group and its part, by distinct weight
    r = got[1, None, 8]
    assert (r.w_sum, r.w_min, r.w_median, r.w_max, r.w_distinct, r.w_nonpositive, r.status) == (6.0, -2.0, 1.0, 3.0, 3, 1, "FAIL")
    r = got[1, "b", 2]
    assert (r.w_sum, r.w_median, r.w_distinct, r.w_nonpositive, r.status) == (3.0, 3.0, 1, 0, "PASS")
    assert got[1, None, 1].w_sum == -2.0 and got[2, "a", 1].w_nonpositive == 1 and got[2, None, 1].w_nonpositive == 1


@pytest.mark.parametrize("rows", [lambda s, sf: learner_queries._frames(s, sf)[1], lambda s, sf: study_queries._rows(s, sf)], ids=["learners", "methods"])
def test_the_cohort_is_joined_once(spark, sf, rows):
    assert "Join" not in rows(spark, sf)._jdf.queryExecution().toString()
