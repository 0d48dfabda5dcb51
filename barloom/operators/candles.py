"""Candlestick patterns and how well a candle fits each, from 0 to 100.

Bearish patterns are bullish ones with prices mirrored, so each shape is written once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ramp, ratio, series, true

LAGS = 3


class Candle:
    """The candle `lag` bars ago; `side` -1 mirrors prices."""

    def __init__(self, lag: int, side: int = 1):
        o, h, l, c = (F.col(f"_{x}{lag}") * side for x in "ohlc")
        self.open, self.close = o, c
        self.high, self.low = (h, l) if side > 0 else (l, h)
        self.body, self.range = F.abs(c - o), self.high - self.low
        self.upper, self.lower = self.high - F.greatest(o, c), F.least(o, c) - self.low
        self.rises, self.falls, self.middle = c > o, c < o, (o + c) / 2

    def within(self, part: Column, share: float) -> Column:
        return (self.range != 0) & (part <= share * self.range)

    def long(self, share: float = 0.5) -> Column:
        return (self.range != 0) & (self.body >= share * self.range)


def mean(*scores: Column) -> Column:
    return sum(scores[1:], scores[0]) / len(scores) * 100


def hammer_shape(side: int) -> tuple[Column, Column]:
    a = Candle(0, side)
    fits = a.within(a.body, 0.3) & (a.lower >= 2 * a.body) & a.within(a.upper, 0.1)
    return fits, mean(ramp(-ratio(a.body, a.range), -0.3, 0.0), ramp(ratio(a.lower, a.body), 2.0, 4.0), ramp(-ratio(a.upper, a.range), -0.1, 0.0))


def doji() -> tuple[Column, Column]:
    a = Candle(0)
    return a.within(a.body, 0.1), ramp(-ratio(a.body, a.range), -0.1, 0.0) * 100


def engulfing(side: int) -> tuple[Column, Column]:
    a, b = Candle(1, side), Candle(0, side)
    return a.falls & b.rises & (b.open <= a.close) & (b.close >= a.open), ramp(ratio(b.body, a.body), 1.0, 2.5) * 100


def star_begins(side: int, lag: int) -> Column:
    a, b = Candle(lag + 1, side), Candle(lag, side)
    return a.falls & a.long() & b.within(b.body, 0.3)


def star(side: int) -> tuple[Column, Column]:
    a, b, c = (Candle(k, side) for k in (2, 1, 0))
    depth = ratio(F.abs(c.close - a.middle), a.body)
    score = mean(ramp(ratio(a.body, a.range), 0.5, 0.9), ramp(-ratio(b.body, b.range), -0.3, 0.0), ramp(depth, 0.0, 1.0))
    return star_begins(side, 1) & c.rises & (c.close > a.middle), score


def three_in_a_row(side: int) -> tuple[Column, Column]:
    a, b, c = three = [Candle(k, side) for k in (2, 1, 0)]
    wicks = [x.high - x.close for x in three]
    fits = a.rises & b.rises & c.rises & (b.close > a.close) & (c.close > b.close)
    for x, y in ((a, b), (b, c)):
        fits = fits & (y.open > x.open) & (y.open < x.close)
    for x, wick in zip(three, wicks, strict=True):
        fits = fits & x.within(wick, 0.25)
    share = sum((ratio(wick, x.range) for x, wick in zip(three[1:], wicks[1:], strict=True)), ratio(wicks[0], a.range)) / 3
    return fits, mean(ramp(-share, -0.25, 0.0), ramp(ratio((c.close - a.close) / 2, b.range), 0.0, 0.5))


def patterns() -> dict[str, tuple[str, Column, Column]]:
    """name: (direction, predicate, confidence), in the order in which they are reported."""
    down, up = F.col("_trend") < 0, F.col("_trend") > 0
    hammer, inverted = hammer_shape(1), hammer_shape(-1)
    return {
        "hammer": ("bullish", hammer[0] & down, hammer[1]), "hanging_man": ("bearish", hammer[0] & up, hammer[1]),
        "shooting_star": ("bearish", inverted[0] & up, inverted[1]), "inverted_hammer": ("bullish", inverted[0] & down, inverted[1]),
        "bullish_engulfing": ("bullish", *engulfing(1)), "bearish_engulfing": ("bearish", *engulfing(-1)),
        "morning_star": ("bullish", *star(1)), "evening_star": ("bearish", *star(-1)),
        "three_white_soldiers": ("bullish", *three_in_a_row(1)), "three_black_crows": ("bearish", *three_in_a_row(-1)),
        "doji": ("neutral", *doji()),
    }


def with_lags(bars: DataFrame) -> DataFrame:
    """Prices of the last candles, and the sign of the five bars before this one."""
    w = series(bars)
    made = {f"_{c[0]}{k}": F.lag(c, k).over(w) if k else F.col(c) for c in ("open", "high", "low", "close") for k in range(LAGS)}
    made["_trend"] = F.signum(F.lag("close", 1).over(w) - F.lag("close", 6).over(w))
    return bars.withColumns(made)


def without_lags(bars: DataFrame) -> DataFrame:
    return bars.drop(*(f"_{c}{k}" for c in "ohlc" for k in range(LAGS)), "_trend")


def candle_patterns(bars: DataFrame) -> DataFrame:
    """A boolean for each pattern, and conf_<pattern>: 0 where it isn't seen; <star>_forming for two candles of three."""
    made = with_lags(bars)
    found = patterns()
    made = made.withColumns({n: true(p) for n, (_, p, _) in found.items()} | {"morning_star_forming": true(star_begins(1, 0)), "evening_star_forming": true(star_begins(-1, 0))})
    return without_lags(made.withColumns({f"conf_{n}": F.when(F.col(n), F.coalesce(c, F.lit(0.0))).otherwise(0.0) for n, (_, _, c) in found.items()}))


DIRECTIONS = {n: d for n, d in zip(
    ("hammer", "hanging_man", "shooting_star", "inverted_hammer", "bullish_engulfing", "bearish_engulfing", "morning_star",
     "evening_star", "three_white_soldiers", "three_black_crows", "doji"),
    ("bullish", "bearish", "bearish", "bullish", "bullish", "bearish", "bullish", "bearish", "bullish", "bearish", "neutral"), strict=True,
)}
