"""Technical indicators: each takes bars and returns them with its columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio, rolling, series, upto
from . import kernels as K
from . import scan

C = F.col


def sma(bars: DataFrame, n: int = 20, of: str = "close", name: str = "sma") -> DataFrame:
    return bars.withColumn(name, rolling(F.avg, of, series(bars), n))


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0, population: bool = False) -> DataFrame:
    """Bands of the sample deviation, or of the population's as charts draw them."""
    w = series(bars)
    bars = bars.withColumn("bb_mid", rolling(F.avg, "close", w, n)).withColumn("_sd", rolling(F.stddev_pop if population else F.stddev_samp, "close", w, n))
    return bars.withColumns({"bb_upper": C("bb_mid") + k * C("_sd"), "bb_lower": C("bb_mid") - k * C("_sd")}).drop("_sd")


def stochastic(bars: DataFrame, n: int = 14, smooth: int = 3) -> DataFrame:
    w = series(bars)
    low, high = rolling(F.min, "low", w, n), rolling(F.max, "high", w, n)
    bars = bars.withColumns({"_lo": low, "_hi": high})
    bars = bars.withColumn("stoch_k", 100 * ratio(C("close") - C("_lo"), C("_hi") - C("_lo"))).drop("_lo", "_hi")
    return bars.withColumn("stoch_d", rolling(F.avg, "stoch_k", w, smooth))


def money_flow_index(bars: DataFrame, n: int = 14) -> DataFrame:
    """Flow of rising typical prices against all other, unchanged ones and the first included."""
    w = series(bars)
    bars = bars.withColumn("_tp", (C("high") + C("low") + C("close")) / 3)
    rising = F.coalesce(C("_tp") > F.lag("_tp").over(w), F.lit(False))
    flow = C("_tp") * C("volume")
    bars = bars.withColumns({"_up": F.when(rising, flow).otherwise(0.0), "_down": F.when(rising, 0.0).otherwise(flow)})
    bars = bars.withColumn("_r", ratio(rolling(F.sum, "_up", w, n), rolling(F.sum, "_down", w, n)))
    return bars.withColumn("mfi", F.coalesce(100 - 100 / (1 + C("_r")), F.lit(50.0))).drop("_tp", "_up", "_down", "_r")


def on_balance_volume(bars: DataFrame) -> DataFrame:
    w = series(bars)
    bars = bars.withColumn("_s", F.coalesce(F.signum(C("close") - F.lag("close").over(w)), F.lit(0.0)) * C("volume"))
    return bars.withColumn("obv", F.sum("_s").over(upto(w))).drop("_s")


def chaikin_money_flow(bars: DataFrame, n: int = 20) -> DataFrame:
    w = series(bars)
    place = ratio((C("close") - C("low")) - (C("high") - C("close")), C("high") - C("low"))
    bars = bars.withColumn("_f", F.coalesce(place, F.lit(0.0)) * C("volume"))
    return bars.withColumn("cmf", F.coalesce(ratio(rolling(F.sum, "_f", w, n), rolling(F.sum, "volume", w, n)), F.lit(0.0))).drop("_f")


def volume_surge(bars: DataFrame, n: int = 20, times: float = 2.0) -> DataFrame:
    return bars.withColumn("volume_surge", F.coalesce(C("volume") > times * rolling(F.avg, "volume", series(bars), n), F.lit(False)))


def awesome_oscillator(bars: DataFrame, fast: int = 5, slow: int = 34) -> DataFrame:
    w = series(bars)
    bars = bars.withColumn("_m", (C("high") + C("low")) / 2)
    return bars.withColumn("ao", rolling(F.avg, "_m", w, fast) - rolling(F.avg, "_m", w, slow)).drop("_m")


def true_range(bars: DataFrame) -> DataFrame:
    before = F.lag("close").over(series(bars))
    return bars.withColumn("true_range", F.greatest(C("high") - C("low"), F.abs(C("high") - before), F.abs(C("low") - before)))


def ema(bars: DataFrame, span: int = 20, of: str = "close", name: str = "ema", slice_: str | None = None) -> DataFrame:
    """With `slice_` (a unit of date_trunc), here and in rsi, adx and range_contraction, a series is worked through in slices,
    each a task's; otherwise as a whole, which suits series that a task can hold."""
    if slice_:
        return scan.ema(bars, span, of, name, slice_)
    return K.add(bars, {name: "double"}, lambda p: {name: K.smooth(p[of], span=span)})


def rsi(bars: DataFrame, period: int = 14, slice_: str | None = None) -> DataFrame:
    if slice_:
        return scan.rsi(bars, period, slice_)
    return K.add(bars, {"rsi": "double"}, lambda p: {"rsi": K.rsi(p, period)})


def average_true_range(bars: DataFrame, period: int = 14) -> DataFrame:
    return K.add(bars, {"atr": "double"}, lambda p: {"atr": K.atr(p, period)}).withColumn("atr", F.nanvl("atr", F.lit(None).cast("double"))).withColumn("atr_pct", ratio("atr", "close"))


def adx(bars: DataFrame, period: int = 14, slice_: str | None = None) -> DataFrame:
    if slice_:
        return scan.adx(bars, period, slice_).drop("atr")
    return K.add(bars, {"adx": "double"}, lambda p: {"adx": K.adx(p, period)})


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    return K.add(bars, dict.fromkeys(("macd_line", "macd_signal", "macd_histogram"), "double"), lambda p: K.macd(p, fast, slow, signal))


def parabolic_sar(bars: DataFrame, step: float = 0.02, most: float = 0.2) -> DataFrame:
    made = K.add(bars, {"sar": "double"}, lambda p: {"sar": K.parabolic_sar(p, step, most)})
    return made.withColumn("sar", F.nanvl("sar", F.lit(None).cast("double")))


def heikin_ashi(bars: DataFrame) -> DataFrame:
    return K.add(bars, dict.fromkeys(("ha_open", "ha_high", "ha_low", "ha_close"), "double"), K.heikin_ashi)


def range_contraction(bars: DataFrame, n: int = 20, q: float = 0.2, slice_: str | None = None) -> DataFrame:
    """Is the mean range within the least `q` of all mean ranges so far (at least n of them, interpolated)? That holds when
    no more than floor(q (m - 1)) of the m are smaller."""
    bars = bars.withColumn("_r", rolling(F.avg, C("high") - C("low"), series(bars), n))
    if slice_:
        bars = scan.ranks_so_far(bars, "_r", "_below", slice_)
    else:
        bars = K.add(bars, {"_below": "long"}, lambda p: {"_below": K.running_rank(p["_r"].to_numpy(float))})
    m = F.count("_r").over(upto(series(bars)))
    return bars.withColumn("contraction", F.coalesce((C("_below") <= F.floor(q * (m - 1))) & (m >= n) & C("_r").isNotNull(), F.lit(False))).drop("_r", "_below")


def debounced(bars: DataFrame, state: Column, confirm: int, *more: str) -> DataFrame:
    """`signal`: a state counts once it has held `confirm` bars, and until another does; 0 before."""
    w = series(bars, *more)
    bars = bars.withColumn("_raw", state)
    bars = bars.withColumn("_new", F.when(C("_raw") == F.lag("_raw").over(w), 0).otherwise(1))
    bars = bars.withColumn("_run", F.sum("_new").over(upto(w)))
    length = F.row_number().over(series(bars, *more, "_run"))
    bars = bars.withColumn("_held", F.when(length >= confirm, C("_raw")))
    return bars.withColumn("signal", F.coalesce(F.last("_held", ignorenulls=True).over(upto(w)), F.lit(0)).cast("int")).drop("_raw", "_new", "_run", "_held")


def overlays(bars: DataFrame) -> DataFrame:
    """What a chart draws, by its own variants: rsi_chart starts from zero averages and is 100 without losses, vwap_chart
    restarts each day and is the close without volume, bands are of the population's deviation, stoch_d_chart is the mean of
    the values that the last three bars have, if all do."""

    def run(p):
        change = p["close"].diff().fillna(0.0)
        gain, loss = (K.smooth(x, alpha=1 / 14) for x in (change.clip(lower=0), -change.clip(upper=0)))
        value = (100 - 100 / (1 + gain / loss.where(loss != 0))).fillna(100.0)
        return {"rsi_chart": value.where(value.index >= 14)}

    made = K.add(bollinger(stochastic(bars).withColumnRenamed("stoch_d", "stoch_d_chart"), population=True), {"rsi_chart": "double"}, run).withColumn("session_date", F.to_date("ts"))
    made = made.withColumn("rsi_chart", F.nanvl("rsi_chart", F.lit(None).cast("double")))
    day = upto(series(made, "session_date"))
    typical = (C("high") + C("low") + C("close")) / 3
    return made.withColumn("vwap_chart", F.coalesce(ratio(F.sum(typical * C("volume")).over(day), F.sum("volume").over(day)), C("close")))

