"""Recurrences by slices, against the same ones over whole series."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import indicators, kernels, scan, strategies

BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def walk(symbol: str, hours: int, seed: int, flat: bool = False) -> list[tuple]:
    draw, price, out = random.Random(seed), 100.0, []
    for t in pd.date_range("2024-01-01", periods=hours, freq="h"):
        last, price = price, price if flat else round(price + draw.gauss(0, 1), 2)
        wide = 0.0 if flat else round(draw.random(), 1)
        out.append((symbol, t.to_pydatetime(), last, max(last, price) + wide, min(last, price) - wide, price, float(draw.randint(0, 9))))
    return out


@pytest.fixture(scope="module")
def bars(spark):
    """A series of 50 days, a flat one, one of a single bar, and one without a name that has a hole of weeks."""
    odd = walk(None, 1200, 3)
    rows = walk("hot", 1200, 1) + walk("flat", 100, 2, True) + walk("one", 1, 4) + odd[:30] + odd[-40:]
    return spark.createDataFrame(random.Random(5).sample(rows, len(rows)), BARS).repartition(7).cache()


def close_to(a, b, column: str) -> None:
    rows = [{(r.symbol, r.ts): r[column] for r in df.collect()} for df in (a, b)]
    assert rows[0].keys() == rows[1].keys()
    for k, v in rows[0].items():
        w = rows[1][k]
        w = None if w is None or w != w else w
        assert (v is None and w is None) or v == pytest.approx(w, rel=1e-9, abs=1e-9), k


@pytest.mark.parametrize("make, column", [
    (lambda b, s: indicators.ema(b, 20, slice_=s), "ema"), (lambda b, s: indicators.rsi(b, 14, s), "rsi"), (lambda b, s: indicators.adx(b, 14, s), "adx"),
])
def test_means_by_days_equal_those_of_whole_series(bars, make, column):
    made = make(bars, "day")
    assert made.columns == [*bars.columns, column] and bars.select(F.date_trunc("day", "ts")).distinct().count() == 50
    close_to(made, make(bars, None), column)


def test_missing_values_across_slices(spark, bars):
    """Slices without a value, series that begin without one, and one that has none; a least number of values."""
    hour = F.hour("ts")
    x = F.when((F.dayofmonth("ts") % 3 != 1) & (hour % 4 != 0) & (F.col("symbol") != "flat"), F.col("close"))
    rows = bars.withColumn("x", x)
    made = scan.exponential_means(scan.sliced(rows, "day"), {"m": ("x", 0.1, 5), "n": ("x", F.lit(0.3), 0)})
    want = kernels.add(rows, {"m": "double", "n": "double"}, lambda p: {"m": kernels.smooth(p["x"].astype(float), alpha=0.1, least=5), "n": kernels.smooth(p["x"].astype(float), alpha=0.3)})
    for c in ("m", "n"):
        close_to(made, want, c)
    assert made.where("symbol = 'flat' and (m is not null or n is not null)").count() == 0
    assert indicators.ema(bars.limit(0), slice_="day").count() == 0


@pytest.mark.parametrize("name, mode", [("bollinger_reversion", "midline"), ("bollinger_reversion", "opposite_extreme")])
def test_positions_by_days(bars, name, mode):
    made = strategies.signals(bars, name, mode, "day")
    whole = strategies.signals(bars, name, mode)
    assert made.columns == whole.columns
    assert made.exceptAll(whole).count() == 0 and made.count() == whole.count()
    assert {r.signal for r in made.select("signal").distinct().collect()} == {-1, 0, 1}


def test_running_rank_equals_counting():
    draw = np.random.default_rng(6)
    for n in (0, 1, 2, 7, 300):
        v = draw.integers(0, 20, n).astype(float)
        v[draw.random(n) < 0.2] = np.nan
        want = [sum(1 for j in range(i) if v[j] < v[i]) for i in range(n)]
        assert kernels.running_rank(v).tolist() == want


def test_ranks_by_slices_and_bins(bars):
    rows = bars.withColumn("x", F.when(F.col("volume") > 0, F.round(F.col("close"))))  # many ties, some missing
    made = scan.ranks_so_far(rows, "x", "below", "day")
    want = kernels.add(rows, {"below": "long"}, lambda p: {"below": kernels.running_rank(p["x"].to_numpy(float))})
    assert made.columns == [*rows.columns, "below"] and made.count() == rows.count() and made.exceptAll(want).count() == 0
    whole = indicators.range_contraction(bars)
    assert whole.exceptAll(indicators.range_contraction(bars, slice_="day")).count() == 0 and whole.where("contraction").count() > 20
