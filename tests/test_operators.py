import datetime as dt
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.tables import materialize
from barloom.operators import analysis, backtest, chart, frames, indicators, journal, kernels, metrics, strategies, ticks
from barloom.plans import queries as plans
from barloom.sources import fixtures, store
from barloom.streaming import bars as stream

SF = "/root/testdata/sf0.001"
BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def walk(seed: int, days: int = 12, per_day: int = 7, symbol: str = "A", jump: float = 0.02):
    rng, price, rows = random.Random(seed), 100.0, []
    for d in range(days):
        for k in range(per_day):
            o = price * (1 + rng.uniform(-jump, jump) / 4)
            c = o * (1 + rng.uniform(-jump, jump))
            rows.append((symbol, dt.datetime(2024, 1, 1, 9, 30) + dt.timedelta(days=d, hours=k), o, max(o, c) * 1.003, min(o, c) * 0.997, c, float(rng.randrange(1, 1000))))
            price = c
    return rows


def scalar(rows, config):
    """A plain event loop over bars with (signal, stop, target): equity and trades."""
    n, slip, fee = len(rows), config.slippage_bps / 1e4, config.commission_per_trade
    signal, days = [r["signal"] for r in rows], [r["ts"].date() for r in rows]
    if config.flatten_eod:
        for i in range(n):
            if days.count(days[i]) > 1 and (i + 1 == n or days[i + 1] != days[i]):
                signal[i] = 0
    later = config.execution_timing == "next_open"
    pos = [0, *signal[:-1]] if later else signal
    fill = [r["open" if later else "close"] for r in rows]
    equity, trades, realised, i = [], [], 0.0, 0
    while i < n:
        j = i
        while j + 1 < n and pos[j + 1] == pos[i]:
            j += 1
        side, capital = pos[i], config.initial_capital + realised
        entry = fill[i] * (1 + slip * side)
        qty = math.floor(capital * config.position_size_pct / entry) if side and capital > 0 else 0
        if qty <= 0:
            equity += [capital] * (j - i + 1)
            i = j + 1
            continue
        stop, target, hit, level = rows[i]["stop_price"], rows[i]["target_price"], None, None
        for k in range(i, j + 1):
            low, high = rows[k]["low"], rows[k]["high"]
            s = stop is not None and (low <= stop if side > 0 else high >= stop)
            t = target is not None and (high >= target if side > 0 else low <= target)
            if s or t:
                first_high = config.intrabar_path == "ohlc"
                hit, level = k, (target if t and (not s or (side > 0) == first_high) else stop)
                break
        out = level * (1 - slip * side) if hit is not None else fill[j + 1] * (1 - slip * side) if j + 1 < n else rows[j]["close"]
        for k in range(i, j + 1):
            if hit is None or k <= hit:
                equity.append(max(0.0, capital - fee + qty * side * (rows[k]["close"] - entry)))
        pnl = qty * side * (out - entry) - 2 * fee
        realised = max(-config.initial_capital, realised + pnl)
        if hit is not None:
            equity += [config.initial_capital + realised] * (j - hit)
        trades.append((rows[i]["ts"], qty, pnl))
        i = j + 1
    return equity, trades


@pytest.mark.parametrize("path", ["ohlc", "olhc"])
@pytest.mark.parametrize("timing", ["next_open", "same_close"])
def test_backtest_against_a_plain_loop(spark, path, timing):
    rng = random.Random(3)
    rows = []
    for s in range(4):
        state = 0
        for r in walk(s, symbol=f"S{s}", jump=0.4 if s == 3 else 0.02):
            state = rng.choice([-1, 0, 1]) if rng.random() < 0.4 else state
            levels = [r[5] * x if rng.random() < 0.7 else None for x in ((0.985, 1.02) if state >= 0 else (1.015, 0.98))]
            rows.append((*r, state, *levels))
    df = spark.createDataFrame(rows, BARS + ", signal int, stop_price double, target_price double")
    config = backtest.Config(commission_per_trade=1.5, intrabar_path=path, execution_timing=timing, flatten_eod=timing == "next_open")
    curve, trades = backtest.run(df, config)
    curve, trades = curve.orderBy("symbol", "ts").collect(), trades.orderBy("symbol", "entry_time").collect()
    for s in range(4):
        mine = [r.asDict() for r in df.where(F.col("symbol") == f"S{s}").orderBy("ts").collect()]
        equity, done = scalar(mine, config)
        assert [r.equity for r in curve if r.symbol == f"S{s}"] == pytest.approx(equity)
        got = [(r.entry_time, r.qty, r.pnl) for r in trades if r.symbol == f"S{s}"]
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in done] and [c for *_, c in got] == pytest.approx([c for *_, c in done])
    assert min(r.equity for r in curve) >= 0


def test_hold_and_fixed_hold():
    rng = random.Random(1)
    p = pd.DataFrame({c: [rng.random() < 0.3 for _ in range(400)] for c in ("_el", "_es", "_xl", "_xs")})
    state, want = 0, []
    for r in p.itertuples(index=False):
        el, es, xl, xs = r
        if (state == 1 and xl) or (state == -1 and xs):
            state = 0
        if state == 0:
            state = 1 if el else -1 if es else 0
        want.append(state)
    assert kernels.hold(p).tolist() == want
    one = pd.DataFrame({"_el": [True] + [False] * 9, "_es": [False] * 10})
    assert kernels.fixed_hold(one, 5).tolist() == [1] * 5 + [0] * 5


def test_running_rank_and_sar():
    import numpy as np

    v = np.array([3, 1, np.nan, 2, 2, 5, 1])
    assert kernels.running_rank(v).tolist() == [0, 0, 0, 1, 1, 4, 0]
    up = pd.DataFrame({"high": [float(i) for i in range(2, 40)], "low": [float(i) for i in range(1, 39)]})
    sar = kernels.parabolic_sar(up)
    assert (sar < up["low"] + 1e-9).all()  # never flips while prices only rise


def test_flat_and_rising_series(spark):
    flat = [("F", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), 5.0, 5.0, 5.0, 5.0, 0.0) for i in range(60)]
    rise = [("R", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), 5.0 + i, 6.0 + i, 5.0 + i, 6.0 + i, 2.0) for i in range(60)]
    df = spark.createDataFrame(flat + rise, BARS)
    last = {r.symbol: r for r in indicators.rsi(indicators.stochastic(indicators.on_balance_volume(indicators.chaikin_money_flow(df)))).where("ts = '2024-01-03 11:00:00'").collect()}
    assert last["F"].rsi == 50 and last["R"].rsi == 50 and last["F"].stoch_k is None and last["F"].cmf == 0
    assert last["R"].obv == 59 * 2.0
    assert frames.session_vwap(df.where("symbol = 'F'")).where("vwap is not null").count() == 0


def test_upsert_deletes_with_an_empty_update(spark):
    old = spark.createDataFrame(walk(1, 1, 3), BARS)
    first = old.orderBy("ts").first()
    new = spark.createDataFrame([("A", first.ts, None, float("nan"), 1.0, 1.0, 1.0)], BARS)
    assert frames.upsert(old, new).count() == 2
    with pytest.raises(frames.InsufficientHistoryError):
        frames.require_days(old, 2)


def test_store_round_trip(spark, tmp_path):
    path = str(tmp_path / "bars")
    rows = spark.createDataFrame(walk(2, 3, 4), BARS).withColumn("interval", F.lit("1h"))
    store.save_bars(spark, path, rows)
    store.save_bars(spark, path, rows.limit(3).withColumn("close", F.lit(1.0)))
    assert store.read_bars(spark, path, ["A"], "1h").count() == 12
    assert store.read_bars(spark, path).where("close = 1").count() == 3
    assert store.get_bars(spark, path, "a", "2024-01-02", "2024-01-02").count() == 4
    assert store.chunks("1m", dt.date(2024, 2, 1))[0] == (dt.date(2024, 1, 2), dt.date(2024, 1, 9))
    raw = spark.createDataFrame([(dt.datetime(2024, 1, 2, 15), 1.0, 2.0, 0.5, 1.5, 10)], "ts timestamp_ntz, Open double, High double, Low double, Close double, Volume long")
    assert store.normalize(raw, "X", "1h").first().ts == dt.datetime(2024, 1, 2, 10)
    with pytest.raises(store.DataFetchError):
        store.normalize(raw.drop("Open"), "X", "1h")


def test_sides_across_slices(spark):
    t = lambda h, m=0: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h, minutes=m)
    trades = spark.createDataFrame([("S", t(0), 9.0, 1.0), ("S", t(2), 10.0, 1.0), ("S", t(50), 10.0, 1.0), ("S", t(51), 9.5, 1.0), ("S", t(52), 10.0, 1.0)], "symbol string, ts timestamp_ntz, price double, size double")
    quotes = spark.createDataFrame([("S", t(1), 9.9, 10.1, 1.0, 1.0), ("S", t(2), 9.5, 9.7, 1.0, 1.0), ("S", t(49), 9.9, 10.1, 1.0, 1.0)], "symbol string, ts timestamp_ntz, bid_price double, ask_price double, bid_size double, ask_size double")
    for size in ("1 day", "1 hour", "100 days"):
        made = [r.side for r in ticks.classify_side(trades, quotes, size).orderBy("ts").collect()]
        assert made == [None, 1.0, 0.0, -1.0, 1.0]


def test_swings_alternate_and_stand_apart(spark):
    df = spark.createDataFrame(walk(5, 40), BARS)
    found = chart.swings(df, 3.0).orderBy("swing_no").collect()
    assert len(found) > 6 and all(a.kind != b.kind and a.bar_idx < b.bar_idx for a, b in zip(found, found[1:]))
    assert all(abs(a.price / b.price - 1) > 0.029 for a, b in zip(found[:-1], found[1:-1]))


def test_a_drawn_double_top_breaks(spark):
    points, rows = [100, 120, 110, 120, 100, 95], []
    for a, b in zip(points, points[1:]):
        rows += [a + (b - a) * k / 10 for k in range(10)]
    bars = [("D", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), p, p + 0.2, p - 0.2, p, 1.0) for i, p in enumerate(rows)]
    found = chart.chart_patterns(spark.createDataFrame(bars, BARS)).where("name = 'double_top'").collect()
    assert len(found) == 1 and found[0].direction == "bearish" and found[0].breakout_price < 110 and found[0].confidence == 100


def test_causality_of_signals(spark):
    """Cutting the end off changes nothing before it."""
    rows = walk(9, 30)
    whole, part = spark.createDataFrame(rows, BARS), spark.createDataFrame(rows[:150], BARS)
    for name in ("ma_crossover", "range_breakout", "macd_crossover", "heikin_ashi_trend"):
        a = {r.ts: r.signal for r in strategies.signals(whole, name).collect()}
        assert all(a[r.ts] == r.signal for r in strategies.signals(part, name).collect())
    with pytest.raises(ValueError):
        strategies.signals(whole, "orb", "no_such_mode")


def test_metrics_without_trades_or_losses(spark):
    rows = [(*r, 0, None, None) for r in walk(1, 3)]
    df = spark.createDataFrame(rows, BARS + ", signal int, stop_price double, target_price double")
    m = metrics.metrics(*backtest.run(df)).first()
    assert m.num_trades == 0 and m.win_rate is None and m.sharpe_ratio is None and m.total_return == 0 and m.profit_factor is None


def test_folds_and_scan(spark):
    df = spark.createDataFrame(walk(4, 12), BARS)
    f = analysis.fold_days(df, 4, 2).groupBy("fold_id", "part").agg(F.min("day").alias("a"), F.max("day").alias("b")).collect()
    at = {(r.fold_id, r.part): (r.a, r.b) for r in f}
    assert [(k, (at[k, "test"][0] - at[k, "before"][0]).days, (at[k, "test"][1] - at[k, "test"][0]).days) for k in range(4)] == [(k, 4, 1) for k in range(4)] and len(at) == 8
    watched = spark.createDataFrame([("A",), ("Z",)], "symbol string")
    assert [r.symbol for r in analysis.scan(df, watched).where("skipped").collect()] == ["Z"]


def test_journal(spark):
    s = spark.createDataFrame([("long", 10.0, 9.0, 12.0), ("short", 10.0, 9.0, 12.0), ("long", 10.0, 10.0, 11.0)], "side string, entry_price double, stop_loss double, target_price double")
    made = journal.suggested_quantity(journal.validate_setup(s)).collect()
    assert made[0].rr_ratio == 2 and not made[0].errors and made[0].suggested_quantity == 200
    # a misplaced stop hides a misplaced target, as the journal has it
    assert len(made[1].errors) == 1 and not made[1].is_valid and made[1].suggested_quantity == 0 and made[2].suggested_quantity == 0
    events = spark.createDataFrame([(1, 1, "create"), (1, 2, "close"), (2, 3, "create"), (2, 4, "delete")], "id long, seq long, event string")
    assert [(r.id, r.event) for r in journal.latest(events).collect()] == [(1, "close")]
    t = spark.createDataFrame([("x", "closed_win", 5.0), ("x", "closed_loss", 0.0), ("y", "open", None)], "setup_type string, status string, net_pl double")
    total = journal.stats(t).where("is_total = 1").first()
    assert total.trades == 2 and total.wins == 1 and total.no_losses and total.profit_factor is None


def test_stream_equals_batch(spark, tmp_path):
    ticks_ = fixtures.trades(spark, SF)
    ticks_.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(ticks_.schema).parquet(str(tmp_path / "in"))
    q = stream.write(stream.ohlcv(live), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    made = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    whole = {tuple(r) for r in stream.ohlcv(ticks_).collect()}
    assert made <= whole and len(whole) - len(made) <= 2


def test_watchlist_and_recommendation(spark):
    from barloom.operators import documents

    log = spark.createDataFrame([("a ", 1, "add"), ("B", 2, "add"), ("A", 3, "add"), ("b", 4, "remove"), ("c", 5, "add"), ("B", 6, "add")], "symbol string, seq long, event string")
    assert [tuple(r) for r in documents.watchlist(log).orderBy("position").collect()] == [("A", 1), ("C", 2), ("B", 3)]
    stats = spark.createDataFrame([("x", "p", "bullish", 10, 0.6, 80.0), ("x", "q", "bearish", 2, None, None), ("x", "r", "neutral", 9, None, 9.0), ("y", "p", "bullish", 0, None, None)],
                                  "symbol string, name string, direction string, occurrences long, win_rate double, avg_confidence double")
    made = {r.symbol: (round(r.score, 6), r.verdict) for r in documents.recommendation(stats).collect()}
    assert made == {"x": (round(0.6 * 0.8 - 0.5 * 0.5 * 0.4, 6), "bullish"), "y": (0.0, "mixed")}


def test_period_windows(spark):
    rows = [("P", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), 1.0, 1.0, 1.0, float(c), 10.0 + i) for i, c in enumerate([10, 11, 12, 13, 12, 11, 10, 11, 12])]
    b = spark.createDataFrame(rows, BARS)
    curve = frames.prepared(b).select("symbol", "ts", "bar_idx", (F.col("close") * 100).alias("equity"))
    p = metrics.best_and_worst(curve)
    got = {(r.kind, r.phase): r for r in metrics.period_windows(p, b, 2).collect()}
    assert {(r.kind, r.change) for r in p.collect()} == {("worst", -300.0), ("best", 300.0)}
    assert got["worst", "during"].num_bars == 4 and got["worst", "pre"].num_bars == 2 and got["worst", "post"].price_change_pct == pytest.approx(12 / 11 - 1)
    assert {(r.kind, round(r.change_pct, 9)) for r in p.collect()} == {("worst", round(-3 / 13, 9)), ("best", 0.3)}
    assert len(got) == 6 and got["best", "pre"].num_bars == 0 and got["best", "pre"].start_ts is None and got["best", "pre"].volume_ratio is None
    assert (got["worst", "during"].start_ts.hour, got["worst", "during"].end_ts.hour) == (3, 6)
    assert got["best", "during"].volume_ratio == pytest.approx(11.5 / 14)


def test_every_strategy_competes_and_the_benchmark_has_no_rank(spark):
    names = strategies.registered()
    assert len(names) == 14 and names[6:9] == ("range_breakout", "chart_pattern_breakout", "awesome_oscillator")
    df = spark.createDataFrame(walk(4, 16), BARS)
    rows = metrics.ranking(analysis.comparison(df), "sharpe_ratio", names).collect()
    ranked, (held,) = [r for r in rows if r.rank is not None], [r for r in rows if r.rank is None]
    assert sorted(r.strategy for r in ranked) == sorted(names) and sorted(r.rank for r in ranked) == list(range(1, 15))
    assert held.strategy == "buy_and_hold" and held.num_trades == 1  # held over night
    best = next(r for r in ranked if r.rank == 1)
    assert math.isclose(held.delta, held.sharpe_ratio - best.sharpe_ratio, abs_tol=1e-9)
    assert plans.NAMES == list(names)  # what the walk-forward queries run


def test_chart_breakouts_and_contraction_are_recent_patterns_and_hits(spark):
    df = spark.createDataFrame(walk(9, 60), BARS)
    n, shapes = df.count(), materialize(chart.chart_patterns(df))
    want = sorted((r.breakout_time, r.name, r.direction) for r in shapes.collect() if r.breakout_idx >= n - 60)
    recent = analysis.recent_patterns(df, 60, shapes).collect()
    assert want and sorted((r.ts, r.name, r.direction) for r in recent if r.pattern_kind == "chart") == want
    last = indicators.range_contraction(df).orderBy(F.desc("ts")).first()
    assert [r.ts for r in recent if r.pattern_kind == "range"] == ([last.ts] if last.contraction else [])
    good = {r.name for r in chart.chart_pattern_stats(df, 10, shapes).collect() if r.occurrences >= 5 and r.win_rate >= 0.3}
    hits = analysis.scan(df, df.select("symbol").distinct(), 0.3, 60).where("pattern_kind = 'chart'").collect()
    assert good and sorted((h.ts, h.name, h.direction) for h in hits) == [w for w in want if w[1] in good]
