"""Risk and return of equity curves, and the ranking of strategies by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import keys, ratio, series, upto
from .strategies import BENCHMARK

C = F.col


def metrics(equity: DataFrame, trades: DataFrame, risk_free: float = 0.0, initial_capital: float = 100_000.0) -> DataFrame:
    """Nine figures a series. Null: fewer than two returns, no deviation, no losses, or nothing left to annualise."""
    per, w = keys(equity), series(equity)
    df = equity.withColumns({"_r": ratio("equity", F.lag("equity").over(w)) - 1, "_peak": F.max("equity").over(upto(w))})
    per_bar = F.count("*").over(Window.partitionBy(*per)) / F.lit(252.0)  # only a rate other than 0 needs the days
    if risk_free:
        days = F.size(F.collect_set(F.to_date("ts")).over(Window.partitionBy(*per)))
        df = df.withColumn("_r", C("_r") - risk_free / (per_bar / days * 252 * 252))
    df = df.withColumn("_dd", ratio(C("equity") - C("_peak"), F.when(C("_peak") != 0, C("_peak"))))
    a = df.groupBy(*per).agg(
        F.count("*").alias("_n"), F.countDistinct(F.to_date("ts")).alias("_days"), F.max_by("equity", "bar_idx").alias("_last"),
        F.avg("_r").alias("_mean"), F.count("_r").alias("_nr"), F.stddev_samp("_r").alias("_sd"), F.stddev_samp(F.when(C("_r") < 0, C("_r"))).alias("_dsd"), F.min("_dd").alias("max_drawdown"),
    )
    a = a.withColumns({"total_return": C("_last") / initial_capital - 1, "_f": F.sqrt(C("_n") / C("_days") * 252)})
    grown = 1 + C("total_return")
    a = a.withColumns({
        "annualized_return": F.when(grown > 0, F.pow(grown, 252 / C("_days")) - 1),
        "sharpe_ratio": F.when(C("_nr") >= 2, ratio("_mean", "_sd") * C("_f")), "sortino_ratio": F.when(C("_nr") >= 2, ratio("_mean", "_dsd") * C("_f")),
    })
    t = trades.groupBy(*per).agg(
        F.count("*").alias("num_trades"), ratio(F.count_if(C("pnl") > 0), F.count("*")).alias("win_rate"),
        ratio(F.sum(F.when(C("pnl") > 0, C("pnl")).otherwise(0.0)), F.abs(F.sum(F.when(C("pnl") < 0, C("pnl")).otherwise(0.0)))).alias("profit_factor"), F.avg("return_pct").alias("avg_trade_return_pct"),
    )
    out = a.join(t, per, "left").withColumn("num_trades", F.coalesce("num_trades", F.lit(0)))
    names = ("total_return", "annualized_return", "sharpe_ratio", "sortino_ratio", "max_drawdown", "win_rate", "profit_factor", "num_trades", "avg_trade_return_pct")
    return out.select(*per, *names)


def place(order: tuple[str, ...]) -> Column:
    """A strategy's number in the order of registration."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, order)), C("strategy")), F.lit(0)) if order else F.lit(0)


def ranking(figures: DataFrame, by: str = "sharpe_ratio", order: tuple[str, ...] = ()) -> DataFrame:
    """rank of each strategy within its symbol, nulls last, ties in the order of registration; delta to the best. The
    benchmark comes after them, has no rank, and its delta is to the best strategy."""
    ranked = C("strategy") != BENCHMARK
    w = Window.partitionBy(*(k for k in keys(figures) if k != "strategy")).orderBy(ranked.desc(), C(by).desc_nulls_last(), place(order), "strategy")
    return figures.withColumns({"rank": F.when(ranked, F.row_number().over(w)), "delta": C(by) - F.first(F.when(ranked, C(by))).over(w)})


def best_and_worst(equity: DataFrame) -> DataFrame:
    """kind, from_ts, to_ts, change, change_pct (of the equity at its start, null where that is 0): the largest fall from a peak and
    the largest rise from a trough; the first of equals."""
    w = series(equity)
    df = equity.withColumns({"_hi": F.max("equity").over(upto(w)), "_lo": F.min("equity").over(upto(w))})
    per = keys(equity)
    # the first time that the running extreme had its value
    df = df.withColumns({"_hi_ts": F.min("ts").over(Window.partitionBy(*per, "_hi")), "_lo_ts": F.min("ts").over(Window.partitionBy(*per, "_lo"))})
    both = df.select(*per, F.lit("worst").alias("kind"), C("_hi_ts").alias("from_ts"), C("ts").alias("to_ts"), (C("equity") - C("_hi")).alias("change"), ratio(C("equity") - C("_hi"), "_hi").alias("change_pct"), (C("_hi") - C("equity")).alias("_size")).unionByName(
        df.select(*per, F.lit("best").alias("kind"), C("_lo_ts").alias("from_ts"), C("ts").alias("to_ts"), (C("equity") - C("_lo")).alias("change"), ratio(C("equity") - C("_lo"), "_lo").alias("change_pct"), (C("equity") - C("_lo")).alias("_size"))
    )
    top = Window.partitionBy(*per, "kind").orderBy(F.desc("_size"), "to_ts")
    return both.withColumn("_rn", F.row_number().over(top)).where("_rn = 1 and _size >= 1e-6").drop("_rn", "_size")


def period_windows(periods: DataFrame, bars: DataFrame, around: int = 10) -> DataFrame:
    """For each best or worst period the bars before, during and after it: first and last time, price change, mean volume and its
    ratio to that of all bars, deviation of returns, and how many there are. A phase without bars has nulls and none."""
    from .frames import prepared

    per = [k for k in keys(bars)]
    b = prepared(bars).withColumns({"_r": ratio("close", F.lag("close").over(series(bars))) - 1, "_mean": F.avg("volume").over(Window.partitionBy(*per))})
    at = b.select(*per, C("ts").alias("_t"), C("bar_idx").alias("_i"))
    ends = periods.join(at.withColumnsRenamed({"_t": "from_ts", "_i": "_a"}), [*per, "from_ts"]).join(at.withColumnsRenamed({"_t": "to_ts", "_i": "_b"}), [*per, "to_ts"])
    own = [c for c in keys(periods) if c not in per]
    j = ends.select(*per, *own, "kind", "_a", "_b").join(b, per)  # two periods a series
    phase = F.when(C("bar_idx").between(C("_a") - around, C("_a") - 1), "pre").when(C("bar_idx").between(C("_a"), C("_b")), "during").when(C("bar_idx").between(C("_b") + 1, C("_b") + around), "post")
    j = j.withColumn("phase", phase).where("phase is not null")
    first = F.min("bar_idx").over(Window.partitionBy(*per, *own, "kind", "phase"))
    j = j.withColumn("_r", F.when(C("bar_idx") > first, C("_r")))  # returns within the phase
    found = j.groupBy(*per, *own, "kind", "phase").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), (ratio(F.max_by("close", "bar_idx"), F.min_by("close", "bar_idx")) - 1).alias("price_change_pct"), F.avg("volume").alias("avg_volume"),
        ratio(F.avg("volume"), F.first("_mean")).alias("volume_ratio"), F.stddev_samp("_r").alias("volatility"), F.count("*").alias("num_bars"),
    )
    every = ends.select(*per, *own, "kind", F.explode(F.array(*map(F.lit, ("pre", "during", "post")))).alias("phase"))
    return every.join(found, [*per, *own, "kind", "phase"], "left").withColumn("num_bars", F.coalesce("num_bars", F.lit(0)))
