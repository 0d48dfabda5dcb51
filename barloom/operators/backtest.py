"""Event-accurate back-tests as three relational steps.

Everything about a run of equal positions but its size is known without knowing capital: where it starts and ends, at what
prices, whether a bracket is touched. Only the account itself goes from one run to the next, and there are few runs. Then
every bar's equity follows from its run.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import keys, series, upto
from .frames import check_bars, prepared, with_bar_minutes

C = F.col


@dataclass(frozen=True)
class Config:
    initial_capital: float = 100_000.0
    position_size_pct: float = 1.0
    commission_per_trade: float = 0.0
    slippage_bps: float = 1.0
    flatten_eod: bool = True
    eod_buffer_minutes: float = 1
    execution_timing: str = "next_open"
    intrabar_path: str = "ohlc"

    def __post_init__(self):
        if self.execution_timing not in ("next_open", "same_close") or self.intrabar_path not in ("ohlc", "olhc"):
            raise ValueError(f"unknown timing {self.execution_timing!r} or path {self.intrabar_path!r}")


def flatten_eod(signals: DataFrame, buffer_minutes: float = 1) -> DataFrame:
    """No signal on the last bars of a session of more than one; half bars round to even."""
    df = with_bar_minutes(signals).withColumn("session_date", F.to_date("ts"))
    day = Window.partitionBy(*keys(df), "session_date")
    n = F.greatest(F.lit(1), F.bround(F.lit(float(buffer_minutes)) / C("bar_minutes"), 0).cast("int"))
    late = (F.row_number().over(day.orderBy(F.desc("ts"))) <= n) & (F.count("*").over(day) > 1)
    return df.withColumn("signal", F.when(late, 0).otherwise(C("signal"))).drop("bar_minutes")


def positions(signals: DataFrame, config: Config = Config()) -> DataFrame:
    """position, fill_price, and run: the number of the stretch of equal positions, from 1."""
    df = prepared(flatten_eod(signals, config.eod_buffer_minutes) if config.flatten_eod else signals)
    w, later = series(df), config.execution_timing == "next_open"
    df = df.withColumns({"position": F.lag("signal", 1, 0).over(w) if later else C("signal"), "fill_price": C("open") if later else C("close")})
    before = F.lag("position").over(w)
    df = df.withColumn("_new", F.when(before.isNull() | (before != C("position")), 1).otherwise(0))
    return df.withColumn("run", F.sum("_new").over(upto(w))).drop("_new")


def runs(df: DataFrame, config: Config = Config()) -> DataFrame:
    """A row for each run that holds a position: entry and exit, before any thought of size."""
    slip, w, per = config.slippage_bps / 1e4, series(df), [*keys(df), "run"]
    one = Window.partitionBy(*per).orderBy("ts")
    df = df.withColumns({
        "_next_fill": F.lead("fill_price").over(w), "_next_ts": F.lead("ts").over(w), "_stop": F.first("stop_price").over(one), "_target": F.first("target_price").over(one),
    }).where("position <> 0")
    long = C("position") > 0
    stopped = F.coalesce(F.when(long, C("low") <= C("_stop")).otherwise(C("high") >= C("_stop")), F.lit(False))
    reached = F.coalesce(F.when(long, C("high") >= C("_target")).otherwise(C("low") <= C("_target")), F.lit(False))
    high_first = config.intrabar_path == "ohlc"
    target_first = long if high_first else ~long  # where both are touched in one bar
    level = F.when(reached & (~stopped | target_first), C("_target")).when(stopped, C("_stop"))
    df = df.withColumn("_level", level)
    out = df.groupBy(*per).agg(
        F.first("position").alias("side"), F.min("bar_idx").alias("i0"), F.max("bar_idx").alias("i1"), F.min("ts").alias("entry_time"),
        F.min_by("fill_price", "bar_idx").alias("_fill"), F.min(F.when(C("_level").isNotNull(), C("bar_idx"))).alias("hit"),
        F.min_by("_level", F.when(C("_level").isNotNull(), C("bar_idx"))).alias("hit_price"),
        F.min_by("ts", F.when(C("_level").isNotNull(), C("bar_idx"))).alias("hit_time"), F.max_by(F.coalesce("_next_ts", "ts"), "bar_idx").alias("_last_time"),
        F.max_by("_next_fill", "bar_idx").alias("next_fill"), F.max_by("close", "bar_idx").alias("last_close"),
    )
    out = out.withColumn("entry_price", C("_fill") * (1 + slip * C("side")))
    gone = 1 - slip * C("side")
    price = F.coalesce(C("hit_price") * gone, C("next_fill") * gone, C("last_close"))
    return out.withColumns({"exit_price": price, "exit_time": F.coalesce("hit_time", "_last_time")}).drop("_fill", "_last_time")


def account(found: DataFrame, config: Config = Config()) -> DataFrame:
    """quantity, capital before and realised profit after each run, in order."""
    start, fee = config.initial_capital, config.commission_per_trade

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("run").reset_index(drop=True)
        realised, made = 0.0, []
        for side, into, out in zip(pdf["side"], pdf["entry_price"], pdf["exit_price"], strict=True):
            capital = start + realised
            quantity = float(np.floor(capital * config.position_size_pct / into)) if capital > 0 and into > 0 else 0.0
            profit = 0.0
            if quantity > 0:
                profit = quantity * side * (out - into) - 2 * fee
                realised = max(-start, realised + profit)
            made.append((max(quantity, 0.0), capital, profit, realised))
        return pdf.assign(**dict(zip(("quantity", "capital", "pnl", "realised"), np.array(made).T, strict=True)))

    from pyspark.sql import types as T

    extra = [T.StructField(c, T.DoubleType()) for c in ("quantity", "capital", "pnl", "realised")]
    return found.groupBy(*keys(found)).applyInPandas(fold, T.StructType([*found.schema.fields, *extra]))


def trades(accounts: DataFrame, config: Config = Config()) -> DataFrame:
    done = accounts.where("quantity > 0")
    return done.select(
        *keys(done), "run", "entry_time", "entry_price", "exit_time", "exit_price", C("side").cast("int").alias("side"), C("quantity").cast("long").alias("qty"),
        "pnl", (C("pnl") / (C("quantity") * C("entry_price"))).alias("return_pct"), F.lit(2 * config.commission_per_trade).alias("commission"), F.lit(config.slippage_bps / 1e4).alias("slippage"),
    )


def equity(df: DataFrame, accounts: DataFrame, config: Config = Config()) -> DataFrame:
    """Equity at each bar: marked at the close through the bar of exit, flat otherwise."""
    per, w, start = keys(df), upto(series(df)), config.initial_capital
    facts = accounts.select(*per, "run", "hit", "entry_price", "quantity", "capital", C("realised").alias("after"))
    df = df.join(facts, [*per, "run"], "left")
    marked = F.greatest(F.lit(0.0), C("capital") - config.commission_per_trade + C("quantity") * C("position") * (C("close") - C("entry_price")))
    held = F.when(C("quantity") <= 0, C("capital")).when(C("bar_idx") > C("hit"), start + C("after")).otherwise(marked)
    df = df.withColumn("_after", F.last("after", ignorenulls=True).over(w))
    flat = start + F.coalesce("_after", F.lit(0.0))
    return df.withColumn("equity", F.when(C("position") == 0, flat).otherwise(held)).select(*per, "ts", "bar_idx", "position", "close", "equity")


def run(signals: DataFrame, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """(equity by bar, trades) of bars that carry signal, stop_price and target_price; every series at once."""
    if "signal" not in signals.columns or not signals.schema["signal"].dataType.simpleString() in ("int", "bigint"):
        raise ValueError("signals need a whole-number column `signal`")
    df = positions(check_bars(signals), config)
    accounts = account(runs(df, config), config)
    return equity(df, accounts, config), trades(accounts, config)
