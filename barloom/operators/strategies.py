"""Trading strategies: an entry rule, ways to leave, and price levels for brackets.

A strategy adds what it needs to the bars and names its long and short entries. How a signal follows from them is the same
for all: `level` holds while the entry is true (short wins), `hold` from entry to exit (long wins), `confirmed` once the
level has lasted, `fixed` for a number of bars.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import keys, last_rows, rolling, series, true
from . import candles, frames, indicators as I, kernels as K, scan

C = F.col


@dataclass(frozen=True)
class Exit:
    kind: str = "level"
    long: Column | None = None
    short: Column | None = None
    stop: tuple[Column, Column] | Column | None = None  # for long and short entries, or one for every bar
    target: tuple[Column, Column] | None = None
    by_session: bool = False
    confirm: int = 3


@dataclass(frozen=True)
class Strategy:
    name: str
    title: str
    prepare: Callable[[DataFrame, dict], DataFrame]
    entries: Callable[[dict], tuple[Column, Column]]
    exits: Callable[[dict], dict[str, Exit]]
    defaults: dict = field(default_factory=dict)

    @property
    def modes(self) -> tuple[str, ...]:
        return MODES[self.name]


REGISTRY: dict[str, Strategy] = {}
#: The exit modes of each strategy, its default first.
MODES = {
    "orb": ("level_reversal", "or_midpoint", "measured_move"), "vwap_reversion": ("threshold_cross", "midline", "opposite_extreme"),
    "ma_crossover": ("signal_reversal", "confirmed_reversal", "slow_ema_stop"), "rsi_reversion": ("threshold_cross", "midline", "opposite_extreme"),
    "volume_momentum": ("level_reversal", "swing_stop", "measured_move"), "candlestick_reversal": ("opposite_pattern", "fixed_hold", "candle_stop"),
    "range_breakout": ("level_reversal", "contraction_stop", "measured_move"), "awesome_oscillator": ("zero_cross", "confirmed_reversal", "swing_stop"),
    "macd_crossover": ("signal_reversal", "histogram_fade", "zero_cross"), "parabolic_sar": ("sar_flip", "confirmed_flip", "sar_bracket"),
    "dual_thrust": ("level_reversal", "session_close_only", "measured_move"), "heikin_ashi_trend": ("shaven_candle", "any_reversal", "entry_candle_stop"),
    "bollinger_reversion": ("threshold_cross", "midline", "opposite_extreme"),
}
#: Settings that are lengths of frames, which Spark wants as literals, and settings that kernels take from a series' rows. All
#: others are used in column arithmetic, and may be columns.
LENGTHS = {
    "orb": ("minutes",), "vwap_reversion": ("std_window",), "volume_momentum": ("lookback",), "range_breakout": ("contraction_lookback", "breakout_lookback"),
    "awesome_oscillator": ("fast", "slow", "swing_lookback"), "dual_thrust": ("lookback_days",), "bollinger_reversion": ("period",),
}
IN_KERNELS = {
    "ma_crossover": ("fast", "slow"), "rsi_reversion": ("period",), "macd_crossover": ("fast", "slow", "signal"), "parabolic_sar": ("af_step", "af_max"),
    "candlestick_reversal": ("fixed_hold_bars",),
}


def strategy(name: str, title: str, prepare, entries, exits, **defaults) -> None:
    """Register a strategy; its first exit mode is the default."""
    REGISTRY[name] = Strategy(name, title, prepare, entries, exits, defaults)


def sign(c: Column) -> tuple[Column, Column]:
    return c > 0, c < 0


def band(c: Column, low: Column | float, high: Column | float) -> tuple[Column, Column]:
    return c < low, c > high


def measured(p: dict, high: Column, low: Column, size: Column) -> Exit:
    return Exit(target=(high + p["target_multiple"] * size, low - p["target_multiple"] * size))


def prior_channel(bars: DataFrame, n: int) -> DataFrame:
    w = series(bars)
    return bars.withColumns({"_ph": rolling(F.max, "high", w, n, end=-1), "_pl": rolling(F.min, "low", w, n, end=-1)})


def _reverting(value: Column, low, high, middle, at_least: bool = False) -> dict[str, Exit]:
    above, below = (value >= high, value <= low) if at_least else (value > high, value < low)
    return {"threshold_cross": Exit(), "midline": Exit("hold", value >= middle, value <= middle), "opposite_extreme": Exit("hold", above, below)}


strategy(
    "orb", "Opening range breakout", lambda b, p: frames.opening_range(b, p["minutes"]),
    lambda p: (C("close") > C("or_high"), C("close") < C("or_low")),
    lambda p: {
        "level_reversal": Exit(), "or_midpoint": Exit("hold", C("close") <= (C("or_high") + C("or_low")) / 2, C("close") >= (C("or_high") + C("or_low")) / 2),
        "measured_move": measured(p, C("or_high"), C("or_low"), C("or_high") - C("or_low")),
    }, minutes=15, target_multiple=1.0,
)


def _vwap(b: DataFrame, p: dict) -> DataFrame:
    b = frames.session_vwap(b)
    b = b.withColumn("_dev", C("close") - C("vwap"))
    return b.withColumn("_band", p["num_std"] * rolling(F.stddev_samp, "_dev", series(b), p["std_window"]))


strategy("vwap_reversion", "VWAP reversion", _vwap, lambda p: band(C("_dev"), -C("_band"), C("_band")),
         lambda p: _reverting(C("_dev"), -C("_band"), C("_band"), 0.0), num_std=1.0, std_window=30)


def _session_emas(b: DataFrame, p: dict) -> DataFrame:
    b = b.withColumn("session_date", F.to_date("ts"))
    fast, slow = p["fast"], p["slow"]
    run = lambda d: {"_fast": K.smooth(d["close"], span=K.given(d, fast)), "_slow": K.smooth(d["close"], span=K.given(d, slow))}
    return K.add(b, {"_fast": "double", "_slow": "double"}, run, "session_date")


strategy("ma_crossover", "EMA crossover", _session_emas, lambda p: sign(C("_fast") - C("_slow")),
         lambda p: {"signal_reversal": Exit(), "confirmed_reversal": Exit("confirmed", by_session=True, confirm=p["confirm_bars"]), "slow_ema_stop": Exit(stop=C("_slow"))},
         fast=9, slow=20, confirm_bars=3)
strategy("rsi_reversion", "RSI reversion", lambda b, p: I.rsi(b, p["period"]), lambda p: band(C("rsi"), p["oversold"], p["overbought"]),
         lambda p: _reverting(C("rsi"), p["oversold"], p["overbought"], 50, at_least=True), period=14, oversold=30, overbought=70)


def _volume(b: DataFrame, p: dict) -> DataFrame:
    return prior_channel(b, p["lookback"]).withColumn("_spike", C("volume") > p["volume_multiplier"] * rolling(F.avg, "volume", series(b), p["lookback"], end=-1))


strategy("volume_momentum", "Volume momentum", _volume, lambda p: ((C("close") > C("_ph")) & C("_spike"), (C("close") < C("_pl")) & C("_spike")),
         lambda p: {"level_reversal": Exit(), "swing_stop": Exit(stop=(C("_pl"), C("_ph"))), "measured_move": measured(p, C("_ph"), C("_pl"), C("_ph") - C("_pl"))},
         lookback=20, volume_multiplier=2.0, target_multiple=1.0)


def _any(*names: str) -> Column:
    out = C(names[0])
    for n in names[1:]:
        out = out | C(n)
    return out


def _candle_exits(p: dict) -> dict[str, Exit]:
    r = p["target_r_multiple"]
    up, down = C("close") + r * (C("close") - C("low")), C("close") - r * (C("high") - C("close"))
    return {"opposite_pattern": Exit(), "fixed_hold": Exit("fixed"), "candle_stop": Exit(stop=(C("low"), C("high")), target=(up, down))}


strategy("candlestick_reversal", "Candlestick reversal", lambda b, p: candles.candle_patterns(b),
         lambda p: (_any("hammer", "bullish_engulfing", "morning_star", "three_white_soldiers"), _any("hanging_man", "bearish_engulfing", "evening_star", "three_black_crows")),
         _candle_exits, fixed_hold_bars=5, target_r_multiple=1.5)


def _coil(b: DataFrame, p: dict) -> DataFrame:
    b = I.range_contraction(b, p["contraction_lookback"], p["contraction_quantile"])
    return prior_channel(b, p["breakout_lookback"]).withColumn("_coiled", F.lag("contraction", 1, False).over(series(b)))


strategy("range_breakout", "Range contraction breakout", _coil, lambda p: (C("_coiled") & (C("close") > C("_ph")), C("_coiled") & (C("close") < C("_pl"))),
         lambda p: {"level_reversal": Exit(), "contraction_stop": Exit(stop=(C("_pl"), C("_ph"))), "measured_move": measured(p, C("_ph"), C("_pl"), C("_ph") - C("_pl"))},
         contraction_lookback=20, contraction_quantile=0.2, breakout_lookback=20, target_multiple=1.0)


def _ao(b: DataFrame, p: dict) -> DataFrame:
    w = last_rows(series(b), p["swing_lookback"], -1)
    return I.awesome_oscillator(b, p["fast"], p["slow"]).withColumns({"_sl": F.min("low").over(w), "_sh": F.max("high").over(w)})


strategy("awesome_oscillator", "Awesome oscillator", _ao, lambda p: sign(C("ao")),
         lambda p: {"zero_cross": Exit(), "confirmed_reversal": Exit("confirmed", confirm=p["confirm_bars"]), "swing_stop": Exit(stop=(C("_sl"), C("_sh")))},
         fast=5, slow=34, confirm_bars=3, swing_lookback=10)


def _macd(b: DataFrame, p: dict) -> DataFrame:
    b = I.macd(b, p["fast"], p["slow"], p["signal"])
    w = series(b)
    up, down = C("macd_line") > C("macd_signal"), C("macd_line") < C("macd_signal")
    b = b.withColumns({"_up": up, "_down": down})
    before = lambda c: F.lag(c, 1, False).over(w)
    return b.withColumns({"_cross_up": C("_up") & ~before("_up"), "_cross_down": C("_down") & ~before("_down"), "_dh": C("macd_histogram") - F.lag("macd_histogram").over(w)})


strategy("macd_crossover", "MACD crossover", _macd, lambda p: (C("_up"), C("_down")),
         lambda p: {"signal_reversal": Exit(), "histogram_fade": Exit("cross", C("_dh") < 0, C("_dh") > 0), "zero_cross": Exit("cross", C("macd_line") <= 0, C("macd_line") >= 0)},
         fast=12, slow=26, signal=9)
strategy("parabolic_sar", "Parabolic SAR", lambda b, p: I.parabolic_sar(b, p["af_step"], p["af_max"]), lambda p: sign(C("close") - C("sar")),
         lambda p: {"sar_flip": Exit(), "confirmed_flip": Exit("confirmed", confirm=p["confirm_bars"]), "sar_bracket": Exit(stop=C("sar"))},
         af_step=0.02, af_max=0.2, confirm_bars=2)


def _thrust(b: DataFrame, p: dict) -> DataFrame:
    b = b.withColumn("session_date", F.to_date("ts"))
    days = frames.resample_daily(b)
    w, n = Window.partitionBy(*keys(days)).orderBy("session_date"), p["lookback_days"]
    past = lambda of, c: rolling(of, c, w, n, end=-1)
    size = F.greatest(past(F.max, "high") - past(F.min, "close"), past(F.max, "close") - past(F.min, "low"))
    days = days.select(*keys(days), "session_date", size.alias("_size"), C("open").alias("_day_open"))
    return b.join(days, [*keys(b), "session_date"]).withColumns({"_buy": C("_day_open") + p["k1"] * C("_size"), "_sell": C("_day_open") - p["k2"] * C("_size")})


strategy("dual_thrust", "Dual thrust", _thrust, lambda p: (C("close") > C("_buy"), C("close") < C("_sell")),
         lambda p: {"level_reversal": Exit(), "session_close_only": Exit("hold", F.lit(False), F.lit(False), by_session=True), "measured_move": measured(p, C("_buy"), C("_sell"), C("_size"))},
         lookback_days=4, k1=0.5, k2=0.5, target_multiple=1.0)


def _shaven(p: dict) -> tuple[Column, Column]:
    size = C("ha_high") - C("ha_low")
    some = size != 0
    return some & (C("ha_close") > C("ha_open")) & (C("ha_open") - C("ha_low") <= p["wick_tolerance"] * size), some & (C("ha_close") < C("ha_open")) & (C("ha_high") - C("ha_open") <= p["wick_tolerance"] * size)


strategy("heikin_ashi_trend", "Heikin-Ashi trend", lambda b, p: I.heikin_ashi(b), _shaven,
         lambda p: {"shaven_candle": Exit(), "any_reversal": Exit("hold", C("ha_close") < C("ha_open"), C("ha_close") > C("ha_open")), "entry_candle_stop": Exit(stop=(C("ha_low"), C("ha_high")))},
         wick_tolerance=0.05)
strategy("bollinger_reversion", "Bollinger reversion", lambda b, p: I.bollinger(b, p["period"], p["num_std"]), lambda p: (C("close") <= C("bb_lower"), C("close") >= C("bb_upper")),
         lambda p: _reverting(C("close"), C("bb_lower"), C("bb_upper"), C("bb_mid"), at_least=True), period=20, num_std=2.0)


BENCHMARK = "buy_and_hold"


def registered() -> tuple[str, ...]:
    """All strategies that compete, in the order of registration; the benchmark does not."""
    out = list(REGISTRY)
    out.insert(out.index("range_breakout") + 1, "chart_pattern_breakout")
    return tuple(out)


def buy_and_hold(bars: DataFrame) -> DataFrame:
    return bars.withColumns({"signal": F.lit(1), "stop_price": F.lit(None).cast("double"), "target_price": F.lit(None).cast("double")})


def signals(bars: DataFrame, name: str, exit_mode: str | None = None, slice_: str | None = None, **params) -> DataFrame:
    """The bars with signal (-1, 0 or 1), stop_price and target_price (null: none). With `slice_`, positions that are held from
    an entry to an exit come from slices of a series, each a task's."""
    if name == BENCHMARK:
        return buy_and_hold(bars)
    if name == "chart_pattern_breakout":
        from . import chart

        return chart.breakout_signals(bars, exit_mode or "level_reversal", **params)
    s = REGISTRY[name]
    p = s.defaults | params
    exits = s.exits(p)
    if exit_mode is not None and exit_mode not in exits:
        raise ValueError(f"{name} has no exit mode {exit_mode!r}")
    way = exits[exit_mode or next(iter(exits))]
    long, short = map(true, s.entries(p))
    made = s.prepare(bars, p).withColumns({"_el": long, "_es": short})
    level = F.when(C("_es"), -1).when(C("_el"), 1).otherwise(0)
    split = ["session_date"] if way.by_session else []
    if way.kind in ("hold", "cross"):
        if way.kind == "cross":
            made = made.withColumns({"_el": true(C("_cross_up")), "_es": true(C("_cross_down"))})
        made = made.withColumns({"_xl": true(way.long), "_xs": true(way.short)})
        if slice_ and not split:
            made = scan.positions(made, slice_)
        else:
            made = K.add(made, {"signal": "int"}, lambda d: {"signal": K.hold(d)}, *split)
    elif way.kind == "fixed":
        bars_held = p["fixed_hold_bars"]
        made = K.add(made, {"signal": "int"}, lambda d: {"signal": K.fixed_hold(d, bars_held)})
    elif way.kind == "confirmed":
        made = I.debounced(made, level, way.confirm, *split)
    else:
        made = made.withColumn("signal", level.cast("int"))

    def price(of) -> Column:
        if of is None:
            return F.lit(None).cast("double")
        return (F.when(C("_es"), of[1]).when(C("_el"), of[0]) if isinstance(of, tuple) else of).cast("double")

    return made.select(*bars.columns, "signal", price(way.stop).alias("stop_price"), price(way.target).alias("target_price"))
