"""Exact quantiles by slices, against numpy and Spark's own median."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions.select import quantiles, with_medians
from barloom.operators import analysis, chart
from barloom.sources import fixtures


@pytest.mark.parametrize("q", [0.0, 0.2, 0.5, 1.0])
def test_quantiles(spark, q):
    """A group of nearly all rows, one value repeated, ties, one row, none, NaN and nulls."""
    draw = random.Random(4)
    rows = [("hot", round(draw.gauss(0, 1), 2), draw.random()) for _ in range(5000)] + [("same", 7.0, None)] * 300 + [("one", 3.0, 4.0), ("none", None, None), ("odd", float("nan"), 1.0), ("odd", 2.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, a double, b double").repartition(16)
    got = {r.g: (r.a, r.b) for r in quantiles(df, ["g"], ["a", "b"], q).collect()}
    for g in ("hot", "same", "one", "odd"):
        for k in (0, 1):
            values = [r[k + 1] for r in rows if r[0] == g and r[k + 1] is not None and r[k + 1] == r[k + 1]]
            assert got[g][k] == (pytest.approx(np.quantile(values, q), rel=1e-12) if values else None)
    assert "none" not in got
    assert quantiles(df.limit(0), ["g"], ["a"]).count() == 0


def test_medians_equal_sparks(spark):
    df = spark.range(1000).selectExpr("id % 7 as g", "cast(hash(id) as double) / 1e6 as x", "if(id % 3 = 0, null, cast(hash(id, 2) % 50 as double)) as y")
    made = with_medians(df, ["g"], {"mx": "x", "my": "y"})
    want = df.groupBy("g").agg(F.median("x").alias("mx"), F.median("y").alias("my"))
    assert made.count() == 1000 and made.select("g", "mx", "my").distinct().exceptAll(want).count() == 0
    assert with_medians(df, [], {"m": "x"}).select("m").distinct().collect()[0].m == df.agg(F.median("x")).first()[0]


def test_no_whole_series_window_is_left(spark):
    bars = fixtures.hourly(spark, "/root/testdata/sf0.001")
    for made in (analysis.classify_regime(bars), chart.swings(bars), analysis.snapshot(bars)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        windows = [x for x in plan.splitlines() if "Window [" in x]
        assert not any("median" in w or w.rstrip().endswith("[symbol]") for w in windows) and "median(" not in plan
