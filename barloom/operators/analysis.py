"""Statistics of signals: regimes, walk-forward folds, win rates, forecasts, cross-sections, scans, snapshots."""

from __future__ import annotations

from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import average_rank, keys, rank_correlation, ratio, rolling, series, true
from ..functions.select import with_medians
from ..functions.tables import materialize
from . import backtest, candles, chart, frames, indicators as I, metrics as M, strategies

C = F.col
LEAST_SEEN = 5  # occurrences from which a win rate counts

#: The indicator conditions and the direction that each claims.
SIGNALS = {
    "rsi_oversold": "bullish", "rsi_overbought": "bearish", "macd_bullish": "bullish", "macd_bearish": "bearish",
    "bollinger_upper_break": "bullish", "bollinger_lower_break": "bearish", "stochastic_oversold": "bullish", "stochastic_overbought": "bearish",
    "awesome_oscillator_positive": "bullish", "awesome_oscillator_negative": "bearish", "above_parabolic_sar": "bullish", "below_parabolic_sar": "bearish",
    "mfi_oversold": "bullish", "mfi_overbought": "bearish", "obv_rising": "bullish", "obv_falling": "bearish",
    "chaikin_money_flow_positive": "bullish", "chaikin_money_flow_negative": "bearish", "volume_surge_up": "bullish", "volume_surge_down": "bearish",
}


#: Places to which scores are rounded before they are ranked.
SCORE_PLACES = 9


def classify_regime(bars: DataFrame) -> DataFrame:
    """trend_regime and vol_regime: ADX and ATR % against the medians of the whole series (so it looks ahead)."""
    df = materialize(I.average_true_range(I.adx(bars)))
    df = with_medians(df, keys(bars), {"_ma": "adx", "_mv": "atr_pct"})
    return df.withColumns({
        "trend_regime": F.when(C("adx") >= C("_ma"), "trending").otherwise("ranging"), "vol_regime": F.when(C("atr_pct") >= C("_mv"), "high_vol").otherwise("low_vol"),
    }).drop("_ma", "_mv")


def days_of(bars: DataFrame, by: list[str]) -> DataFrame:
    """day_no (from 0) of each trading day."""
    days = bars.select(*by, F.to_date("ts").alias("day")).distinct()
    return days.withColumn("day_no", F.row_number().over(Window.partitionBy(*by).orderBy("day")) - 1)


def fold_days(bars: DataFrame, before: int, test: int, by: list[str] | None = None) -> DataFrame:
    """A row for each day of each fold: fold_id, part (`before` or `test`) and day. A day is in before/test folds at most, and
    rows join by day."""
    by = keys(bars) if by is None else by
    days = days_of(bars, by).withColumn("_n", F.max(C("day_no") + 1).over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))))
    first = F.greatest(F.ceil((C("day_no") - before - test + 1) / test), F.lit(0))
    f = days.withColumn("fold_id", F.explode(F.sequence(first.cast("int"), F.floor(C("day_no") / test).cast("int"))))
    f = f.where(C("fold_id") * test + before + test <= C("_n"))
    return f.select(*by, "fold_id", F.when(C("day_no") < C("fold_id") * test + before, "before").otherwise("test").alias("part"), "day")


def walk_forward(bars: DataFrame, names: list[str], regime_days: int = 20, test_days: int = 5, config: backtest.Config = backtest.Config(), by: str = "sharpe_ratio") -> DataFrame:
    """A row for each (series, fold, strategy): the fold's regime, the strategy's figures on its test days alone (where its
    indicators start anew) and whether it won. Folds and strategies are keys, so all run at once."""
    per = keys(bars)
    bars = materialize(bars)
    table = materialize(fold_days(bars, regime_days, test_days))
    regime = classify_regime(bars).select(*per, "ts", "trend_regime", "vol_regime", F.to_date("ts").alias("day"))
    at = regime.join(table.where("part = 'before'"), [*per, "day"])
    at = at.groupBy(*per, "fold_id").agg(F.max_by("trend_regime", "ts").alias("trend_regime"), F.max_by("vol_regime", "ts").alias("vol_regime"))
    test = bars.withColumn("day", F.to_date("ts")).join(table.where("part = 'test'").drop("part"), [*per, "day"]).drop("day")
    figures = compare(test, names, config)
    out = figures.join(at, [*per, "fold_id"])
    ranked = M.ranking(out, by, tuple(names))
    return ranked.withColumn("won", (C("rank") == 1) & C(by).isNotNull()).drop("rank", "delta")


def regime_map(walk: DataFrame, by: str = "sharpe_ratio") -> DataFrame:
    """Figures of each strategy in each regime of a series and its place: by mean, then wins, then the order of registration."""
    per = [k for k in keys(walk) if k not in ("strategy", "fold_id")]
    out = walk.groupBy(*per, "trend_regime", "vol_regime", "strategy").agg(F.count_if("won").alias("wins"), F.count("*").alias("folds"), F.avg(by).alias("avg_metric"))
    w = Window.partitionBy(*per, "trend_regime", "vol_regime").orderBy(C("avg_metric").desc_nulls_last(), C("wins").desc(), M.place(strategies.registered()), "strategy")
    return out.withColumn("place", F.row_number().over(w))


def recommend(walk: DataFrame, bars: DataFrame, by: str = "sharpe_ratio") -> DataFrame:
    """Each series' current regime, and the best strategy of its folds in that regime, or of all its folds where it has none;
    null for a series without folds."""
    per = keys(bars)
    now = classify_regime(bars).groupBy(*per).agg(F.max_by("trend_regime", "ts").alias("trend_regime"), F.max_by("vol_regime", "ts").alias("vol_regime"))
    walk = materialize(walk)
    best = regime_map(walk, by).where("place = 1").select(*per, "trend_regime", "vol_regime", C("strategy").alias("_s"))
    overall = walk.groupBy(*per, "strategy").agg(F.avg(by).alias("_m"), F.count_if("won").alias("_w")).where("_m is not null")
    top = overall.groupBy(*per).agg(F.max_by("strategy", F.struct("_m", "_w", -M.place(strategies.registered()))).alias("_o"))
    return now.join(best, [*per, "trend_regime", "vol_regime"], "left").join(top, per, "left").select(*per, "trend_regime", "vol_regime", F.coalesce("_s", "_o").alias("recommended"))


def regime_stretches(regimes: DataFrame) -> DataFrame:
    """Runs of bars of one trend and volatility regime: number, first and last bar, and how many."""
    per, w = keys(regimes), series(regimes)
    at = F.concat_ws("/", "trend_regime", "vol_regime")
    df = regimes.withColumn("_at", at).withColumn("_new", F.when(C("_at") == F.lag("_at").over(w), 0).otherwise(1)).withColumn("stretch", F.sum("_new").over(w))
    return df.groupBy(*per, "stretch", "trend_regime", "vol_regime").agg(F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts"), F.count("*").alias("bars"))


def compare(bars: DataFrame, names: list[str], config: backtest.Config = backtest.Config()) -> DataFrame:
    """Figures of each strategy on each series, from one back-test of all. Bars are written once and each strategy's signals
    too, as rows of one table: a plan of fourteen takes the driver minutes."""
    frames.check_bars(bars)
    bars, signals = materialize(bars), None
    for name in names:
        one = materialize(strategies.signals(bars, name).withColumn("strategy", F.lit(name)))
        signals = one if signals is None else signals.unionByName(one)
    curve, trades = map(materialize, backtest.run(materialize(signals), config))
    return M.metrics(curve, trades, initial_capital=config.initial_capital)


def comparison_report(bars: DataFrame, names: tuple[str, ...] = (), config: backtest.Config = backtest.Config(), wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(figures as comparison() has them, failures), the latter with a row for each series and strategy that has none, and why.

    A series that frames.check_series() finds fault with fails in all strategies; a strategy that fails on one series, in its
    kernel, fails there alone; one that can't be planned, for its settings, fails on all. Everything else is as without them.
    """
    frames.check_bars(bars)
    names, per = [*(names or strategies.registered()), strategies.BENCHMARK], keys(bars)
    checked = materialize(frames.check_series(bars, wanted))
    good = materialize(bars.join(checked.where("error is null"), per, "left_semi")).withColumn("error", F.lit(None).cast("string"))
    failed = checked.where("error is not null").select(*per, F.explode(F.array(*map(F.lit, names))).alias("strategy"), "error")
    figures = None
    for some, how in ((names[:-1], config), (names[-1:], replace(config, flatten_eod=False))):
        made = None
        for name in some:
            try:
                one = materialize(strategies.signals(good, name).withColumn("strategy", F.lit(name)))
            except (ValueError, KeyError, AnalysisException) as e:
                failed = failed.unionByName(checked.where("error is null").select(*per, F.lit(name).alias("strategy"), F.lit(f"{type(e).__name__}: {e}").alias("error")))
                continue
            made = one if made is None else made.unionByName(one)
        if made is None:
            continue
        lost = made.where("error is not null").groupBy(*per, "strategy").agg(F.min("error").alias("error"))
        curve, trades = map(materialize, backtest.run(materialize(made.join(lost, [*per, "strategy"], "left_anti").drop("error")), how))
        some_figures = M.metrics(curve, trades, initial_capital=how.initial_capital)
        figures, failed = some_figures if figures is None else figures.unionByName(some_figures), failed.unionByName(lost)
    return figures, failed


def comparison(bars: DataFrame, names: tuple[str, ...] = (), config: backtest.Config = backtest.Config()) -> DataFrame:
    """Figures of the named strategies, or all, and of the benchmark, which holds over night."""
    figures = compare(bars, list(names or strategies.registered()), config)
    return figures.unionByName(compare(bars, [strategies.BENCHMARK], replace(config, flatten_eod=False)))


def indicator_signals(bars: DataFrame) -> DataFrame:
    """A boolean for each of SIGNALS."""
    df = I.volume_surge(I.chaikin_money_flow(I.on_balance_volume(I.money_flow_index(I.awesome_oscillator(I.stochastic(I.bollinger(bars)))))))
    df = I.parabolic_sar(I.macd(I.rsi(df)))
    df = df.withColumn("_obv20", rolling(F.avg, "obv", series(df), 20))
    of: dict[str, Column] = {
        "rsi_oversold": C("rsi") < 30, "rsi_overbought": C("rsi") > 70, "macd_bullish": C("macd_line") > C("macd_signal"), "macd_bearish": C("macd_line") < C("macd_signal"),
        "bollinger_upper_break": C("close") > C("bb_upper"), "bollinger_lower_break": C("close") < C("bb_lower"),
        "stochastic_oversold": C("stoch_k") < 20, "stochastic_overbought": C("stoch_k") > 80, "awesome_oscillator_positive": C("ao") > 0, "awesome_oscillator_negative": C("ao") < 0,
        "above_parabolic_sar": C("close") > C("sar"), "below_parabolic_sar": C("close") < C("sar"), "mfi_oversold": C("mfi") < 20, "mfi_overbought": C("mfi") > 80,
        "obv_rising": C("obv") > C("_obv20"), "obv_falling": C("obv") < C("_obv20"), "chaikin_money_flow_positive": C("cmf") > 0, "chaikin_money_flow_negative": C("cmf") < 0,
        "volume_surge_up": C("volume_surge") & (C("close") > C("open")), "volume_surge_down": C("volume_surge") & (C("close") < C("open")),
    }
    return df.select(*bars.columns, *(true(of[n]).alias(n) for n in SIGNALS))


def long_form(df: DataFrame, directions: dict[str, str], keep: list[str], confidence: bool = False) -> DataFrame:
    """name, direction, seen (and confidence) for every row and signal."""
    items = [F.struct(F.lit(n).alias("name"), F.lit(d).alias("direction"), C(n).alias("seen"), (C(f"conf_{n}") if confidence else F.lit(None).cast("double")).alias("confidence")) for n, d in directions.items()]
    return df.select(*keep, F.explode(F.array(*items)).alias("s")).select(*keep, "s.*")


def win_stats(long: DataFrame, by: list[str]) -> DataFrame:
    """occurrences with a known return, win rate in the stated direction, mean return and confidence; all signals stay."""
    hit = C("seen") & C("forward_return").isNotNull()
    win = F.when(C("direction") == "bullish", C("forward_return") > 0).when(C("direction") == "bearish", C("forward_return") < 0)
    return long.groupBy(*by, "name", "direction").agg(
        F.count_if(hit).alias("occurrences"), F.avg(F.when(hit, win.cast("double"))).alias("win_rate"),
        F.avg(F.when(hit, C("forward_return"))).alias("avg_forward_return"), F.avg(F.when(hit, C("confidence"))).alias("avg_confidence"),
    )


def pattern_stats(bars: DataFrame, ahead: int = 10) -> DataFrame:
    df = frames.forward_return(candles.candle_patterns(bars), ahead)
    per = keys(bars)
    return win_stats(long_form(df, candles.DIRECTIONS, [*per, "forward_return"], True), per)


def indicator_stats(bars: DataFrame, ahead: int = 10) -> DataFrame:
    df = frames.forward_return(indicator_signals(bars), ahead)
    per = keys(bars)
    return win_stats(long_form(df, SIGNALS, [*per, "forward_return"]), per).drop("avg_confidence")


def weight() -> Column:
    """What a signal's win rate is worth, in its direction: nothing up to a coin's, or seen too rarely."""
    size = F.greatest(F.lit(0.0), (C("win_rate") - 0.5) * 2)
    known = (C("occurrences") >= LEAST_SEEN) & C("win_rate").isNotNull()
    return F.when(known & (C("direction") == "bullish"), size).when(known & (C("direction") == "bearish"), -size).otherwise(0.0)


def all_signals(bars: DataFrame, ahead: int) -> DataFrame:
    """Candle patterns and indicator signals in long form, with the forward return."""
    per = keys(bars)
    df = frames.forward_return(indicator_signals(candles.candle_patterns(bars)), ahead)
    return long_form(df, candles.DIRECTIONS | SIGNALS, [*per, "ts", "forward_return"]).withColumn("day", F.to_date("ts"))


def composite_score(bars: DataFrame, ahead: int = 10) -> DataFrame:
    """score of each series' last bar: the mean weight of the signals true on it, 0 without any."""
    per = keys(bars)
    long = all_signals(bars, ahead)
    stats = win_stats(long, per).withColumn("weight", weight()).where("weight <> 0").select(*per, "name", "weight")
    last = long.withColumn("_last", F.max("ts").over(Window.partitionBy(*per))).where("ts = _last")
    joined = last.join(stats, [*per, "name"], "left")
    return joined.groupBy(*per).agg(F.max("ts").alias("as_of"), F.coalesce(F.avg(F.when(C("seen"), C("weight"))), F.lit(0.0)).alias("score"), F.count(F.when(C("seen"), C("weight"))).alias("contributing"))


def scored(long: DataFrame, table: DataFrame, per: list[str], pooled: bool) -> DataFrame:
    """Test rows of each fold with `score`, the mean of the weights that training gave to the signals true on them."""
    by = [] if pooled else per
    part = lambda name: long.join(table.where(C("part") == name).drop("part"), [*by, "day"])
    stats = win_stats(part("before"), [*by, "fold_id"])
    weights = stats.withColumn("weight", weight()).where("weight <> 0").select(*by, "fold_id", "name", "weight")
    test = part("test").join(weights, [*by, "fold_id", "name"], "left")
    return test.groupBy(*per, "fold_id", "ts", "forward_return").agg(F.avg(F.when(C("seen"), C("weight"))).alias("score"))


def validate_forecast(bars: DataFrame, ahead: int = 1, train_days: int = 60, test_days: int = 20) -> DataFrame:
    """Hit rate, coverage and base rate of each fold, and of all folds together (fold_id null). Returns at the end of training
    reach into the test, as measured."""
    per = keys(bars)
    long = materialize(all_signals(bars, ahead))
    rows = scored(long, fold_days(bars, train_days, test_days), per, False)
    used = C("score").isNotNull() & C("forward_return").isNotNull()
    up = C("forward_return") > 0
    return rows.groupingSets([[*per, "fold_id"], per], *per, "fold_id").agg(
        F.count("*").alias("n_test_bars"), F.count_if(used).alias("n_predictions"), ratio(F.count_if(used), F.count("*")).alias("coverage"),
        ratio(F.count_if(used & ((C("score") > 0) == up)), F.count_if(used)).alias("hit_rate"), ratio(F.count_if(used & up), F.count_if(used)).alias("baseline_up_rate"),
    )


def validate_cross_section(bars: DataFrame, ahead: int = 1, train_days: int = 60, test_days: int = 20, least: int = 5) -> DataFrame:
    """Per fold, and over all (fold_id null): rank correlation of pooled scores with returns at the times that all symbols
    have, its hit rate, and the mean return above the median score less that below. Scores are means of weights, rounded to
    SCORE_PLACES, so that equal ones tie in whatever order they were added. Symbols with fewer days than training
    and two tests leave the universe; fewer than `least` that stay are an error."""
    per = keys(bars)
    enough = bars.groupBy(*per).agg(F.countDistinct(F.to_date("ts")).alias("_d")).where(C("_d") >= train_days + 2 * test_days).select(*per)
    bars = materialize(bars.join(enough, per, "left_semi"))
    n = bars.select(*per).distinct().count()
    if n < least:
        raise frames.InsufficientHistoryError(n, least, "symbols with enough trading days")
    common = bars.groupBy(F.to_date("ts").alias("day")).agg(F.countDistinct(*per).alias("k")).where(C("k") == n).select("day")
    whole = bars.join(common, F.to_date("ts") == C("day"), "left_semi")
    table = materialize(fold_days(whole, train_days, test_days, []))
    long = materialize(all_signals(bars, ahead))
    at_all = bars.groupBy("ts").agg(F.countDistinct(*per).alias("k")).where(C("k") == n).select("ts")
    rows = scored(long, table, per, True).join(at_all, "ts", "left_semi").where("forward_return is not null").withColumn("score", F.coalesce(F.round("score", SCORE_PLACES), F.lit(0.0)))
    at = ["fold_id", "ts"]
    together = Window.partitionBy(*at)
    rows = rows.withColumns({"_rs": average_rank(C("score"), at), "_rr": average_rank(C("forward_return"), at), "_m": F.median("score").over(together), "_k": F.count("*").over(together)})
    per_ts = rows.groupBy(*at).agg(
        rank_correlation(C("_rs"), C("_rr"), C("_k")).alias("ic"), F.count("*").alias("k"), F.countDistinct("score").alias("_d"),
        (F.avg(F.when(C("score") > C("_m"), C("forward_return"))) - F.avg(F.when(C("score") < C("_m"), C("forward_return")))).alias("spread"),
    ).where((C("k") >= least) & (C("_d") >= 2) & C("ic").isNotNull())
    found = per_ts.groupingSets([["fold_id"], []], "fold_id").agg(F.count("*").alias("n_timestamps"), F.avg("ic").alias("mean_ic"), F.avg((C("ic") > 0).cast("double")).alias("ic_hit_rate"), F.avg("spread").alias("top_minus_bottom_spread"))
    every = table.select("fold_id").distinct().unionByName(bars.sparkSession.createDataFrame([(None,)], "fold_id int"))
    joined = every.join(found.withColumnRenamed("fold_id", "_f"), C("fold_id").eqNullSafe(C("_f")), "left").drop("_f")
    return joined.withColumn("n_timestamps", F.coalesce("n_timestamps", F.lit(0)))


def recent_patterns(bars: DataFrame, lookback: int = 5, shapes: DataFrame | None = None) -> DataFrame:
    """What each series' last bars show, by pattern_kind: candlesticks, confirmed or forming on the last bar; breakouts of
    chart patterns; a contracted range on the last bar. `shapes`: chart_patterns of the bars, where they are known."""
    per, last = keys(bars), F.row_number().over(series(bars).orderBy(F.desc("ts")))
    df = candles.candle_patterns(bars).withColumn("_back", last).where(C("_back") <= lookback)
    seen = long_form(df, candles.DIRECTIONS, [*per, "ts", "_back"], True).where("seen").withColumn("state", F.lit("confirmed"))
    forming = long_form(df.where("_back = 1"), {"morning_star_forming": "bullish", "evening_star_forming": "bearish"}, [*per, "ts", "_back"]).where("seen").withColumn("state", F.lit("forming"))
    columns = [*per, "ts", "name", "direction", "state", "confidence", "pattern_kind"]
    out = seen.unionByName(forming).withColumn("pattern_kind", F.lit("candlestick")).select(*columns)
    shapes = materialize(chart.chart_patterns(bars)) if shapes is None else shapes
    broken = shapes.join(bars.groupBy(*per).agg(F.count("*").alias("_n")), per).where(C("breakout_idx") >= C("_n") - lookback)
    broken = broken.withColumns({"ts": C("breakout_time").cast(bars.schema["ts"].dataType), "state": F.lit("confirmed"), "pattern_kind": F.lit("chart")})
    coiled = I.range_contraction(bars).withColumn("_back", last).where((C("_back") == 1) & C("contraction"))
    coiled = coiled.withColumns({"name": F.lit("range_contraction"), "direction": F.lit("neutral"), "state": F.lit("contraction"), "confidence": F.lit(None).cast("double"), "pattern_kind": F.lit("range")})
    return out.unionByName(broken.select(*columns)).unionByName(coiled.select(*columns))


def scan(bars: DataFrame, watchlist: DataFrame, least_win: float = 0.55, lookback: int = 5, ahead: int = 10) -> DataFrame:
    """Recent candlesticks and chart breakouts of watched symbols with a good record, best first; watched symbols without
    bars come as skipped."""
    watched = watchlist.select("symbol").distinct()
    some = materialize(bars.join(watched, "symbol", "left_semi"))
    per, shapes = keys(bars), materialize(chart.chart_patterns(some))
    stats = pattern_stats(some, ahead).withColumn("pattern_kind", F.lit("candlestick"))
    stats = stats.unionByName(chart.chart_pattern_stats(some, ahead, shapes).withColumn("pattern_kind", F.lit("chart")))
    good = stats.where((C("win_rate") >= least_win) & (C("occurrences") >= LEAST_SEEN)).select(*per, "pattern_kind", "name", "win_rate", "occurrences", "avg_forward_return")
    hits = recent_patterns(some, lookback, shapes).where("state = 'confirmed'").join(good, [*per, "pattern_kind", "name"])
    hits = hits.select("symbol", "ts", "name", "pattern_kind", "direction", "confidence", "win_rate", "occurrences", "avg_forward_return", F.lit(False).alias("skipped"))
    none = watched.join(bars.select("symbol").distinct(), "symbol", "left_anti").withColumn("skipped", F.lit(True))
    return hits.unionByName(none, allowMissingColumns=True).orderBy("skipped", F.desc_nulls_last("win_rate"), F.desc("occurrences"), "symbol", F.desc("ts"), "pattern_kind", "name")


def snapshot(bars: DataFrame) -> DataFrame:
    """Eight gauges of each series' last bar: value, label, and a place from 0 to 100."""
    per = keys(bars)
    df = frames.session_vwap(I.money_flow_index(I.stochastic(bars)))
    df = with_medians(materialize(I.average_true_range(I.adx(I.macd(I.rsi(df))))), per, {"_median": "atr_pct"})
    whole = Window.partitionBy(*per)
    known = F.last("atr_pct", ignorenulls=True).over(series(df).rowsBetween(Window.unboundedPreceding, 0))
    over = lambda c, base: F.when(base > 0, c / base).otherwise(1.0)
    df = df.withColumns({"_atr": known, "_mean": rolling(F.avg, "volume", series(df), 20, 1)})
    df = df.withColumns({
        "_atr_ratio": F.when(C("_atr").isNotNull(), over(C("_atr"), C("_median"))), "_vol_ratio": over(C("volume"), C("_mean")),
        "_dev": F.when(C("vwap").isNotNull(), F.when(C("vwap") > 0, (C("close") - C("vwap")) / C("vwap")).otherwise(0.0)),
    })
    last = df.withColumn("_back", F.row_number().over(whole.orderBy(F.desc("ts")))).where("_back = 1")

    def label(c: Column, high: float, low: float, names: tuple[str, str, str]) -> Column:
        return F.when(c > high, names[0]).when(c < low, names[2]).otherwise(names[1])

    swing = F.when(C("macd_histogram").isNotNull(), F.coalesce(ratio("macd_histogram", 0.02 * C("close")), F.lit(0.0)))
    gauges = {  # what is unknown stands in the middle, and an unknown trend at 30
        "rsi": (C("rsi"), label(C("rsi"), 70, 30, ("Overbought", "Neutral", "Oversold")), C("rsi"), 50.0),
        "macd": (C("macd_histogram"), label(C("macd_histogram"), 0, 0, ("Bullish", "Neutral", "Bearish")), 50 + 50 * swing, 50.0),
        "stochastic": (C("stoch_k"), label(C("stoch_k"), 80, 20, ("Overbought", "Neutral", "Oversold")), C("stoch_k"), 50.0),
        "adx": (C("adx"), label(C("adx"), 25, 20, ("Trending", "Transitional", "Ranging")), C("adx"), 30.0),
        "atr_pct": (C("_atr"), label(C("_atr_ratio"), 1.5, 0.67, ("Elevated", "Normal", "Low")), 50 + 50 * (C("_atr_ratio") - 1), 50.0),
        "volume": (C("_vol_ratio"), label(C("_vol_ratio"), 1.3, 0.7, ("Above average", "Average", "Below average")), 50 * C("_vol_ratio"), 50.0),
        "mfi": (C("mfi"), label(C("mfi"), 80, 20, ("Overbought", "Neutral", "Oversold")), C("mfi"), 50.0),
        "vwap": (C("_dev"), label(C("_dev"), 0.003, -0.003, ("Above VWAP", "At VWAP", "Below VWAP")), 50 + 50 * C("_dev") / 0.01, 50.0),
    }
    clip = lambda c, unknown: F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(c, F.lit(unknown))))
    rows = F.array(*(F.struct(F.lit(n).alias("gauge"), v.cast("double").alias("value"), x.alias("label"), clip(g, u).alias("gauge_pct")) for n, (v, x, g, u) in gauges.items()))
    return last.select(*per, "ts", F.explode(rows).alias("g")).select(*per, "ts", "g.*")
