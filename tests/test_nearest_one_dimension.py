"""Distances to the nearest row of the other group in one dimension."""

import numpy as np
import pytest

from evenkeel.operators import geometry as G


def test_frames_grow_with_their_rows(spark):
    rng = np.random.default_rng(3)
    x, a = rng.integers(0, 4_000, 3_000) / 8, rng.integers(0, 2, 3_000)
    df = spark.createDataFrame([(float(v), "ab"[g]) for v, g in zip(x, a, strict=True)], "x double, g string")
    out = G.div_nearest(df, "g", "x", "a", "b", ranges=2)
    brute = [np.abs(x[i] - x[a != a[i]]).min() for i in range(len(x))]
    assert out.first().g == pytest.approx(float(np.mean(brute)))
    # a frame from the row to the end of its range would be read anew for each row
    assert "currentrow$(), unboundedfollowing$()" not in out._jdf.queryExecution().toString()
