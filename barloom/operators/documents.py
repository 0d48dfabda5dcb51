"""What a dashboard shows of a series, as JSON documents made by Spark, and the list of watched symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import keys
from ..functions.tables import materialize
from . import analysis, candles, chart

C = F.col


def bars_document(bars: DataFrame) -> DataFrame:
    """bars_json of each series: time in epoch seconds, prices, volume, and a marker for each pattern, whose alpha grows with
    confidence."""
    per = keys(bars)
    df = candles.candle_patterns(bars)
    marks = F.filter(
        F.array(*(F.when(C(n), F.struct(F.lit(n).alias("name"), F.lit(d).alias("direction"), (0.4 + 0.6 * C(f"conf_{n}") / 100).alias("alpha"))) for n, d in candles.DIRECTIONS.items())),
        lambda m: m.isNotNull(),
    )
    row = F.struct(F.unix_seconds(C("ts").cast("timestamp")).alias("time"), "open", "high", "low", "close", "volume", marks.alias("markers"))
    return df.groupBy(*per).agg(F.to_json(F.array_sort(F.collect_list(row))).alias("bars_json"))


def patterns_document(bars: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """patterns_json of each series; `shapes`: chart_patterns of the bars, where they are known."""
    per = keys(bars)
    row = F.struct("place", "name", "direction", "confidence", "vertices", "trendlines", "breakout_time", "breakout_price")
    return (chart.chart_patterns(bars) if shapes is None else shapes).groupBy(*per).agg(F.to_json(F.array_sort(F.collect_list(row))).alias("patterns_json"))


def stats_table(stats: DataFrame) -> DataFrame:
    """Rows in the order of a table: by direction, then win rate with unknown ones last; low_sample marks few occurrences."""
    w = Window.partitionBy(*keys(stats), "direction").orderBy(F.coalesce("win_rate", F.lit(-1.0)).desc(), "name")
    return stats.withColumns({"row": F.row_number().over(w), "low_sample": C("occurrences") < analysis.LEAST_SEEN})


def symbol_document(bars: DataFrame) -> DataFrame:
    """One document a series: bars, chart patterns, both tables of statistics, gauges."""
    per, bars = keys(bars), materialize(bars)
    shapes = materialize(chart.chart_patterns(bars))
    pack = lambda df, name: df.groupBy(*per).agg(F.to_json(F.sort_array(F.collect_list(F.struct(*(c for c in df.columns if c not in per))))).alias(name))
    out = bars_document(bars)
    for df in (patterns_document(bars, shapes), pack(analysis.pattern_stats(bars), "stats_json"), pack(chart.chart_pattern_stats(bars, found=shapes), "chart_stats_json"), pack(analysis.snapshot(bars).drop("ts"), "gauges_json")):
        out = out.join(materialize(df), per, "left")
    return out


def recommendation(stats: DataFrame) -> DataFrame:
    """score and verdict of each series from its pattern statistics: win rate, confidence and sample size, by direction."""
    side = F.when(C("direction") == "bullish", 1).when(C("direction") == "bearish", -1)
    worth = F.coalesce("win_rate", F.lit(0.5)) * F.coalesce("avg_confidence", F.lit(50.0)) / 100 * F.least(F.lit(1.0), C("occurrences") / F.lit(float(analysis.LEAST_SEEN)))
    score = F.coalesce(F.sum(F.when(C("occurrences") > 0, side * worth)), F.lit(0.0))
    verdict = F.when(F.abs("score") < 0.05, "mixed").when(C("score") > 0, "bullish").otherwise("bearish")
    return stats.groupBy(*keys(stats)).agg(score.alias("score")).withColumn("verdict", verdict)


def watchlist(entries: DataFrame) -> DataFrame:
    """symbol, position of a log of (symbol, seq, event): upper case, each once where first added since its last removal."""
    df = entries.withColumn("symbol", F.upper(F.trim("symbol"))).where("symbol <> ''")
    gone = Window.partitionBy("symbol")
    df = df.withColumn("_gone", F.coalesce(F.max(F.when(C("event") == "remove", C("seq"))).over(gone), F.lit(-1)))
    kept = df.where((C("event") == "add") & (C("seq") > C("_gone"))).groupBy("symbol").agg(F.min("seq").alias("_at"))
    return kept.select("symbol", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_at")).alias("position"))
