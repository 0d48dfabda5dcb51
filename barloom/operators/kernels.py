"""Sequential recurrences, series by series, in Arrow batches.

A series has at most one row per bar time, so a group is bounded by the calendar: ten million rows are a century of minutes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.columns import keys


def given(p: pd.DataFrame, value):
    """A setting: the value, or what the series has in the column of that name."""
    return p[value].iloc[0] if isinstance(value, str) else value


def add(df: DataFrame, made: dict[str, str], run, *more: str) -> DataFrame:
    """Columns `made` (name: type) that `run` computes from each series in order of time; `more` columns split series.

    Where the rows have a column `error`, a series on which `run` fails gets the reason there and nulls, and all others go on.
    """
    per, forgiving = [*keys(df), *more], "error" in df.columns
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T._parse_datatype_string(t)) for n, t in made.items())])

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable").reset_index(drop=True)
        if not forgiving:
            return pdf.assign(**run(pdf))
        try:
            return pdf.assign(**run(pdf))
        except Exception as e:
            return pdf.assign(**dict.fromkeys(made)).assign(error=f"{type(e).__name__}: {e}")

    return df.groupBy(*per).applyInPandas(work, schema)


def smooth(s: pd.Series, span: float | None = None, alpha: float | None = None, least: int = 0) -> pd.Series:
    """Exponential mean from the first value on; missing values are stepped over with decaying weight."""
    return s.ewm(span=span, alpha=alpha, adjust=False, min_periods=least).mean()


def true_range(p: pd.DataFrame) -> pd.Series:
    before = p["close"].shift()
    return pd.concat([p["high"] - p["low"], (p["high"] - before).abs(), (p["low"] - before).abs()], axis=1).max(axis=1)


def rsi(p: pd.DataFrame, period: int = 14) -> pd.Series:
    """50 where undefined, also while nothing has been lost."""
    period = given(p, period)
    change = p["close"].diff()
    gain, loss = (smooth(x, alpha=1 / period, least=period) for x in (change.clip(lower=0), -change.clip(upper=0)))
    return (100 - 100 / (1 + gain / loss.where(loss != 0))).fillna(50.0)


def atr(p: pd.DataFrame, period: int = 14) -> pd.Series:
    return smooth(true_range(p), alpha=1 / period, least=period)


def adx(p: pd.DataFrame, period: int = 14) -> pd.Series:
    up, down = p["high"].diff(), -p["low"].diff()
    moves = (up.where((up > down) & (up > 0), 0.0), down.where((down > up) & (down > 0), 0.0))
    range_ = atr(p, period)
    plus, minus = (100 * smooth(m, alpha=1 / period, least=period) / range_.where(range_ != 0) for m in moves)
    both = plus + minus
    return smooth(100 * (plus - minus).abs() / both.where(both != 0), alpha=1 / period, least=period).fillna(0.0)


def macd(p: pd.DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> dict[str, pd.Series]:
    line = smooth(p["close"], span=given(p, fast)) - smooth(p["close"], span=given(p, slow))
    of = smooth(line, span=given(p, signal))
    return {"macd_line": line, "macd_signal": of, "macd_histogram": line - of}


def parabolic_sar(p: pd.DataFrame, step: float = 0.02, most: float = 0.2) -> np.ndarray:
    high, low, n, step, most = p["high"].to_list(), p["low"].to_list(), len(p), given(p, step), given(p, most)
    out = np.full(n, np.nan)
    if n < 2:
        return out
    side = 1 if high[1] >= high[0] else -1  # prices are mirrored while falling, so one rule serves
    ahead, behind = (high, low) if side > 0 else ([-x for x in low], [-x for x in high])
    sar, extreme, speed = behind[0], ahead[0], step
    out[0] = side * sar
    for i in range(1, n):
        sar = min(sar + speed * (extreme - sar), *behind[max(0, i - 2) : i])
        if behind[i] < sar:
            side = -side
            sar, extreme, speed = -extreme, -behind[i], step
            ahead, behind = [-x for x in behind], [-x for x in ahead]
        elif ahead[i] > extreme:
            extreme, speed = ahead[i], min(speed + step, most)
        out[i] = side * sar
    return out


def heikin_ashi(p: pd.DataFrame) -> dict[str, pd.Series]:
    close = (p["open"] + p["high"] + p["low"] + p["close"]) / 4
    start = smooth(pd.concat([p["open"].iloc[:1], close.iloc[:-1]], ignore_index=True), alpha=0.5)
    rows = pd.concat([start, close, p["high"]], axis=1), pd.concat([start, close, p["low"]], axis=1)
    return {"ha_open": start, "ha_high": rows[0].max(axis=1), "ha_low": rows[1].min(axis=1), "ha_close": close}


def running_rank(values: np.ndarray) -> np.ndarray:
    """How many earlier positions hold a smaller value; missing values don't count, and have 0. By merging neighbouring runs:
    each is as long as both before, and its right half learns how many of its left half are smaller."""
    at = np.flatnonzero(values == values)
    order = np.argsort(values[at], kind="stable")
    rank = np.empty(len(at), np.int64)
    rank[order] = np.cumsum(np.append(0, np.diff(values[at][order]) > 0)[: len(at)])
    below, place, width = np.zeros(len(at), np.int64), np.arange(len(at)), 1
    while width < len(at):
        left = place // width % 2 == 0
        by = np.lexsort((left, rank, place // (2 * width)))  # of equal values, those of the right half come first
        smaller = np.cumsum(left[by])
        run = (place // (2 * width))[by]
        smaller -= np.append(0, smaller)[np.searchsorted(run, run)]  # what runs before hold
        below[by] += np.where(left[by], 0, smaller)
        width *= 2
    out = np.zeros(len(values), np.int64)
    out[at] = below
    return out


def hold(p: pd.DataFrame, state: int = 0) -> np.ndarray:
    """A position lasts from its entry to its exit; a bar that ends one may begin another, long before short. `state` is what
    is held before the first bar."""
    out = []
    for el, es, xl, xs in zip(p["_el"], p["_es"], p["_xl"], p["_xs"], strict=True):
        if (xl, xs)[state < 0] if state else True:
            state = 1 if el else -1 if es else 0
        out.append(state)
    return np.array(out, np.int32)


def fixed_hold(p: pd.DataFrame, bars: int = 5) -> np.ndarray:
    """A position lasts so many bars, or until the opposite pattern."""
    state, until, out, bars = 0, 0, [], given(p, bars)
    for i, (el, es) in enumerate(zip(p["_el"], p["_es"], strict=True)):
        if state and (i >= until or (es if state > 0 else el)):
            state = 0
        if not state and (el or es):
            state, until = (1 if el else -1), i + bars
        out.append(state)
    return np.array(out, np.int32)
