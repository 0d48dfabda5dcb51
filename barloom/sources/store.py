"""Stored bars and ticks, partitioned so that a symbol, an interval or a day is one folder."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import files
from ..functions.tables import materialize
from ..operators import frames
from .feeds import last_of_time, ticks_schema
from .versions import VersionedTable

BARS = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("interval", T.StringType()), T.StructField("ts", T.TimestampNTZType()),
    *(T.StructField(c, T.DoubleType()) for c in frames.OHLCV),
])
#: Days of history that a provider keeps, and days to one request, by interval.
LOOKBACK_DAYS = {"1m": 30, "5m": 60, "15m": 60, "30m": 60, "1h": 725, "1d": 3650}
CHUNK_DAYS = {"1m": 7}
#: The names under which providers send the five columns.
RENAMED = {"Open": "open", "High": "high", "Low": "low", "Close": "close", "Volume": "volume"}


class DataFetchError(RuntimeError):
    """A provider gave nothing usable."""


def normalize(raw: DataFrame, symbol: str | None = None, interval: str | None = None, zone: str = "America/New_York") -> DataFrame:
    """Provider rows as bars: renamed, in exchange-local time without zone (naive times count as UTC), one row a time."""
    df = raw.withColumnsRenamed({k: v for k, v in RENAMED.items() if k in raw.columns})
    missing = [c for c in (*frames.OHLCV, "ts") if c not in df.columns]
    if missing:
        raise DataFetchError(f"missing columns: {', '.join(missing)}")
    if isinstance(df.schema["ts"].dataType, T.TimestampNTZType):
        ts = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("ts"))
    else:
        ts = F.convert_timezone(F.current_timezone(), F.lit(zone), F.col("ts").cast("timestamp_ntz"))
    df = df.withColumn("ts", ts)
    for c, v in (("symbol", symbol), ("interval", interval)):
        df = df.withColumn(c, F.lit(v)) if v is not None else df
    df = df.withColumn("_at", F.monotonically_increasing_id())
    one = df.groupBy("symbol", "interval", "ts").agg(*(F.max_by(c, "_at").alias(c) for c in frames.OHLCV))
    return one.select(*(F.col(f.name).cast(f.dataType) for f in BARS))


def chunks(interval: str, until: date) -> list[tuple[date, date]]:
    """The requests that cover what a provider keeps."""
    start, step = until - timedelta(days=LOOKBACK_DAYS[interval]), timedelta(days=CHUNK_DAYS.get(interval, LOOKBACK_DAYS[interval]))
    out = []
    while start < until:
        out.append((start, min(start + step, until)))
        start += step
    return out


def bars_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, BARS, ["interval", "symbol"])


def read_bars(spark: SparkSession, path: str, symbols: list[str] | None = None, interval: str | None = None) -> DataFrame:
    df = bars_table(spark, path).read()
    df = df.where(F.col("interval") == interval) if interval else df
    return df.where(F.col("symbol").isin(symbols)) if symbols else df


def save_bars(spark: SparkSession, path: str, new: DataFrame) -> None:
    """Merge rows into the store. Only the symbols and intervals in `new` are read and written again, to a new version, which
    then counts; one whose rows are all deleted is gone. Rows without symbol or interval are left out."""
    new = materialize(new.select(*BARS.names).na.drop(subset=["interval", "symbol"]))
    table, touched = bars_table(spark, path), new.select("interval", "symbol").distinct()
    old = table.read().join(touched, ["interval", "symbol"], "left_semi")
    table.replace(frames.upsert(old.select(*BARS.names), new), touched)


def get_bars(spark: SparkSession, path: str, symbol: str, start: str, end: str, interval: str = "1h", min_days: int = 0) -> DataFrame:
    return frames.require_days(frames.between(read_bars(spark, path, [symbol.upper()], interval), start, end), min_days)


DAYS = T.StructType([*(T.StructField(c, T.StringType()) for c in ("source", "kind", "symbol")), T.StructField("date", T.DateType())])


def wanted_days(spark: SparkSession, symbols: list[str], start: date, end: date) -> DataFrame:
    """symbol, date of each day from `start` to `end`, both included."""
    days = F.explode(F.sequence(F.lit(start), F.lit(end))) if start <= end else F.explode(F.array().cast("array<date>"))
    return spark.createDataFrame([(s.upper(),) for s in symbols], "symbol string").select("symbol", days.alias("date"))


def missing_days(spark: SparkSession, path: str, source: str, kind: str, wanted: DataFrame, today: date, refresh_today: bool = True) -> DataFrame:
    """The days of `wanted` (symbol, date) that were never kept. A day without a tick was kept if it has been asked for; today and
    later ones never are."""
    if not files.exists(f"{path}/days"):
        return wanted
    kept = spark.read.schema(DAYS).parquet(f"{path}/days").where((F.col("source") == source) & (F.col("kind") == kind))
    kept = kept.where(F.col("date") < F.lit(today)) if refresh_today else kept
    return wanted.join(kept, ["symbol", "date"], "left_anti")


def save_ticks(path: str, ticks: DataFrame, days: DataFrame, source: str, kind: str, today: date) -> None:
    """Keep the ticks of `days` (symbol, date) before today, and then that these days are kept. What breaks off in between is
    asked for and written again."""
    past = F.col("date") < F.lit(today)
    rows = ticks.withColumns({"source": F.lit(source), "kind": F.lit(kind), "date": F.to_date("ts")}).where(past).join(days, ["symbol", "date"], "left_semi")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "kind", "symbol", "date").parquet(f"{path}/ticks")
    days.where(past).select(F.lit(source).alias("source"), F.lit(kind).alias("kind"), "symbol", "date").coalesce(1).write.mode("append").parquet(f"{path}/days")


def read_ticks(spark: SparkSession, path: str, symbols: list[str], start: date, end: date, source: str, kind: str) -> DataFrame:
    """Kept ticks, with their date. All conditions are on partitions, so only the folders of these days are read."""
    schema = T.StructType([*ticks_schema().fields, T.StructField("date", T.DateType())])
    if not files.exists(f"{path}/ticks"):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(f"{path}/ticks").where((F.col("source") == source) & (F.col("kind") == kind))
    return rows.where(F.col("symbol").isin([s.upper() for s in symbols]) & F.col("date").between(F.lit(start), F.lit(end))).select(*schema.names)


def get_ticks_cached(spark: SparkSession, path: str, fetch: Callable[[DataFrame], DataFrame], symbols: list[str], start: date, end: date,
                     source: str = "alpaca", kind: str = "trades", today: date | None = None, refresh_today: bool = True) -> DataFrame:
    """Ticks of all days from `start` to `end`, one to a symbol and time; only days that were never kept are fetched.

    `fetch` gets those days (symbol, date) as a table, to join, and returns ticks as feeds.as_ticks() does. They are kept, but for
    today's and later ones, and everything is then read from where it is kept. Kept days don't change.
    """
    today = today or date.today()
    gaps = materialize(missing_days(spark, path, source, kind, wanted_days(spark, symbols, start, end), today, refresh_today)).where(F.col("date") >= F.lit(start))
    past, now = gaps.where(F.col("date") < F.lit(today)), gaps.where(F.col("date") >= F.lit(today))
    if not past.isEmpty():
        save_ticks(path, fetch(past), past, source, kind, today)
    rows = read_ticks(spark, path, symbols, start, end, source, kind)
    if not now.isEmpty():
        fresh = fetch(now).withColumn("date", F.to_date("ts")).join(now, ["symbol", "date"], "left_semi")
        rows = rows.where(F.col("date") < F.lit(today)).unionByName(fresh)
    return last_of_time(rows, "date").select(*ticks_schema().names)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
