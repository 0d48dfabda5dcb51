"""Bars, ticks and a journal made of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").cast("double").alias("volume")
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"), F.count("*").cast("double").alias("volume"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return e.select(F.lit("EVT").alias("symbol"), "ts", F.col("value").alias("price"), (1 + F.col("event_id") % 5).cast("double").alias("size"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'view'")
    return e.select(
        F.lit("EVT").alias("symbol"), "ts", (F.col("value") * 0.999).alias("bid_price"), (F.col("value") * 1.001).alias("ask_price"),
        (1 + F.col("event_id") % 7).cast("double").alias("bid_size"), (1 + F.col("event_id") % 3).cast("double").alias("ask_size"),
    )


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, p = F.col("o_orderstatus"), F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("setup_type"), F.when(F.col("o_orderkey") % 2 == 0, "long").otherwise("short").alias("side"),
        F.col("o_orderdate").alias("entry_timestamp"), F.when(s != "O", F.round(p - 250000, 2)).alias("net_pl"),
        F.when(s == "O", "open").when(s == "P", "invalidated").when(p > 250000, "closed_win").otherwise("closed_loss").alias("status"),
    )


def setups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade setups with stops and targets on either side of the entry."""
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k % 2 == 0, "long").otherwise("short").alias("side"), p.alias("entry_price"), (p * (1 + (k % 7 - 4) / 100.0)).alias("stop_loss"), (p * (1 + (k % 11 - 5) / 50.0)).alias("target_price"),
        (k % 3 == 0).alias("volume_confirmed"), (k % 5 == 0).alias("higher_tf_aligned"),
    )


def provider_archive(spark: SparkSession, sf_dir: str) -> str:
    """Minute bars of the events under a provider's names, times in UTC; the folder they are in."""
    e, path = table(spark, sf_dir, "events"), shared_dir(spark)
    bars = e.groupBy(F.lit("1m").alias("interval"), F.upper("event_type").alias("symbol"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts")).agg(
        F.min_by("value", "ts").alias("Open"), F.max("value").alias("High"), F.min("value").alias("Low"), F.max_by("value", "ts").alias("Close"), F.count("*").alias("Volume")
    )
    bars.write.partitionBy("interval", "symbol").parquet(path)
    return path


def feed_archive(spark: SparkSession, sf_dir: str) -> str:
    """Files of three feeds, made of the events by their type: root/source/kind, times in UTC. Every tenth event comes twice to a time."""
    e, root, k = table(spark, sf_dir, "events"), shared_dir(spark), F.col("event_id")
    ts = F.when(k % 10 == 0, F.date_trunc("hour", "ts").cast("timestamp_ntz")).otherwise(F.col("ts").cast("timestamp_ntz")).alias("timestamp")
    base = [F.concat(F.lit("S"), (F.col("user_id") % 3).cast("string")).alias("symbol"), ts, k.alias("seq")]
    price, size = F.col("value").alias("price"), (1 + k % 5).alias("size")
    e.where("event_type = 'purchase'").select(*base, price, size, (k % 4).cast("string").alias("exchange"), F.array(F.lit("@"), (k % 2).cast("string")).alias("conditions"), F.lit("more").alias("tape")).write.parquet(f"{root}/alpaca/trades")
    e.where("event_type = 'view'").select(*base, (F.col("value") - 1).alias("bid_price"), (F.col("value") + 1).alias("ask_price"), size.alias("bid_size"), F.lit("V").alias("bid_exchange")).write.parquet(f"{root}/alpaca/quotes")
    e.where("event_type = 'click'").select(*base, price, size, F.when(k % 2 == 0, "A").otherwise("B").alias("side"), (k % 7).alias("publisher_id")).write.parquet(f"{root}/databento/trades")
    return root
