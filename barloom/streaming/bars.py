"""Bars and ticks as streams: event-time OHLCV with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ohlcv(ticks: DataFrame, bucket: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Bars of a stream (or table) of symbol, ts, price, size, each once its time is past the watermark. Later ticks are
    dropped."""
    at = F.col("ts").cast("timestamp")
    df = ticks.withColumn("ts", at)
    df = df.withWatermark("ts", late) if df.isStreaming else df
    return df.groupBy("symbol", F.window("ts", bucket)).agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("size").alias("volume")
    ).select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def deduplicated(ticks: DataFrame, id_col: str, late: str = "10 minutes") -> DataFrame:
    """Each id once within the watermark."""
    df = ticks.withColumn("ts", F.col("ts").cast("timestamp"))
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark([id_col]) if df.isStreaming else df.dropDuplicates([id_col])


def write(bars: DataFrame, path: str, checkpoint: str):
    """Append finished bars to a table and return the running query; it stops when the input is read up."""
    return bars.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
