"""Parameter sets as rows, and comparisons in which something fails."""

import pytest
from pyspark.sql import functions as F

from barloom.operators import analysis, backtest, frames, kernels, metrics, strategies, sweep
from barloom.plans.queries import SETTINGS
from barloom.sources import fixtures

SF = "/root/testdata/sf0.001"


def figures_of(rows, *by):
    return {tuple(r[k] for k in by): tuple(None if v is None else round(v, 9) for c, v in r.asDict().items() if c not in (*by, "place")) for r in rows}


def test_nine_settings_equal_nine_runs(spark):
    bars = fixtures.hourly(spark, SF)
    made = figures_of(sweep.sweep(bars, sweep.parameter_sets(spark, "ma_crossover", SETTINGS), "ma_crossover").collect(), "symbol", "set_id")
    for k, s in enumerate(SETTINGS):
        curve, trades = backtest.run(strategies.signals(bars, "ma_crossover", **s))
        for (symbol,), want in figures_of(metrics.metrics(curve, trades).collect(), "symbol").items():
            assert made[symbol, k] == want


@pytest.mark.parametrize("name", sorted(strategies.REGISTRY))
def test_defaults_as_rows_equal_defaults(spark, name):
    """Every strategy, in its last exit mode, once by its defaults and once by a set that moves a setting."""
    bars, mode = fixtures.hourly(spark, SF).where("symbol in ('view', 'click')"), strategies.MODES[name][-1]
    s = strategies.REGISTRY[name]
    moved = {k: v * 2 for k, v in s.defaults.items() if isinstance(v, float)} or {k: v + 2 for k, v in s.defaults.items()}
    made = sweep.sweep_signals(bars, sweep.parameter_sets(spark, name, [{}, moved, {"nobody": 3}], mode), name)
    key = lambda rows: sorted((r.symbol, r.ts, r.signal, r.stop_price, r.target_price) for r in rows)
    made = made.collect()
    as_row = lambda k: key(r for r in made if r.set_id == k)
    assert repr(as_row(0)) == repr(key(strategies.signals(bars, name, mode).collect())) == repr(as_row(2))
    assert repr(as_row(1)) == repr(key(strategies.signals(bars, name, mode, **moved).collect()))


def test_settings_are_typed_by_defaults(spark):
    sets = sweep.parameter_sets(spark, "rsi_reversion", [{"period": "9.0", "oversold": 25.0}, {"overbought": "80", "else": "x"}])
    rows = sweep.typed(sets, "rsi_reversion").orderBy("set_id").collect()
    assert [(r.p_period, r.p_oversold, r.p_overbought) for r in rows] == [(9, 25, 70), (14, 30, 80)]
    assert dict(sweep.typed(sweep.parameter_sets(spark, "parabolic_sar", [{}]), "parabolic_sar").dtypes)["p_af_step"] == "double"
    with pytest.raises(ValueError, match="unknown strategy"):
        sweep.typed(sets, "nothing")
    with pytest.raises(ValueError, match="exit mode"):
        sweep.sweep_signals(fixtures.hourly(spark, SF), sweep.parameter_sets(spark, "rsi_reversion", [{}], "none"), "rsi_reversion")
    assert sweep.sweep_signals(fixtures.hourly(spark, SF), sets.limit(0), "rsi_reversion").count() == 0
    listed = {r.name: r for r in sweep.catalogue(spark).collect()}
    assert [tuple(p) for p in listed["ma_crossover"].params] == [("fast", "int", "9"), ("slow", "int", "20"), ("confirm_bars", "int", "3")]
    assert listed["orb"].exit_modes == list(strategies.MODES["orb"])


def test_failures_leave_the_others_alone(spark, monkeypatch):
    bars = fixtures.hourly(spark, SF).where("symbol in ('view', 'click')")
    names = ("rsi_reversion", "awesome_oscillator", "nothing")
    bad = bars.where("symbol = 'view'").withColumn("symbol", F.lit("BAD"))
    bad = bad.withColumn("close", F.when(F.hour("ts") != 4, F.col("close")))
    plain = analysis.comparison(bars, names[:2])
    wanted = spark.createDataFrame([("view",), ("NONE",), ("NONE",)], "symbol string")
    figures, failed = analysis.comparison_report(bars.unionByName(bad), names, wanted=wanted)
    assert figures_of(figures.collect(), "symbol", "strategy") == figures_of(plain.collect(), "symbol", "strategy")
    got = {(r.symbol, r.strategy): r.error for r in failed.collect()}
    every = [*names, "buy_and_hold"]
    assert {k for k in got} == {(s, n) for s in ("BAD", "NONE") for n in every} | {("view", "nothing"), ("click", "nothing")}
    assert got["BAD", "orb" if "orb" in names else "nothing"].startswith("close missing in ") and got["NONE", "buy_and_hold"] == "no bars" and "nothing" in got["view", "nothing"]


def test_a_kernel_that_fails_on_one_series(spark):
    bars = fixtures.hourly(spark, SF).where("symbol in ('view', 'click')").withColumn("error", F.lit(None).cast("string"))

    def run(p):
        if p["symbol"].iloc[0] == "view":
            raise ArithmeticError("odd")
        return {"x": p["close"] * 2}

    rows = kernels.add(bars, {"x": "double"}, run).collect()
    assert all((r.error, r.x) == ("ArithmeticError: odd", None) if r.symbol == "view" else r.error is None and r.x == 2 * r.close for r in rows)
    with pytest.raises(Exception, match="odd"):
        kernels.add(bars.drop("error"), {"x": "double"}, run).collect()


def test_series_are_checked(spark):
    rows = [("A", 1, 1, 1.0), ("A", 2, 2, 1.0), ("B", 1, 1, 1.0), ("B", 1, 2, 1.0), ("C", 2, 1, float("nan")), ("C", 1, 2, None), ("D", 1, 1, 1.0)]
    bars = spark.createDataFrame(rows, "symbol string, d int, seq long, close double").selectExpr("symbol", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(d) as ts", "seq", "close as open", "close as high", "close as low", "close", "1.0 as volume")
    got = {r.symbol: r.error for r in frames.check_series(bars, spark.createDataFrame([("E",), ("A",)], "symbol string")).collect()}
    assert got == {"A": None, "B": "times repeated in 1 bars", "D": None, "E": "no bars",
                   "C": "; ".join(f"{c} missing in 2 bars" for c in ("open", "high", "low", "close")) + "; times go back in 1 bars"}
    assert frames.check_series(bars.limit(0)).count() == 0
