"""Feeds of ticks: what each source has of each kind, under which columns, and all of them as one table."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ZONE = "America/New_York"


@dataclass(frozen=True)
class Feed:
    """Ticks of one source and kind. `one_a_time`: of rows of one symbol and time only the last counts."""

    source: str
    kind: str
    columns: dict[str, str] = field(hash=False)
    one_a_time: bool


FEEDS: dict[tuple[str, str], Feed] = {}


def register(feed: Feed) -> Feed:
    FEEDS[feed.source, feed.kind] = feed
    return feed


#: The sources, their kinds and columns.
register(Feed("alpaca", "trades", {"price": "double", "size": "double", "exchange": "string", "conditions": "array<string>"}, True))
register(Feed("alpaca", "quotes", {"bid_price": "double", "bid_size": "double", "ask_price": "double", "ask_size": "double", "bid_exchange": "string", "ask_exchange": "string"}, True))
register(Feed("databento", "trades", {"price": "double", "size": "double", "side": "string", "publisher_id": "int"}, False))


def feed_of(source: str, kind: str) -> Feed:
    """The feed asked for, or ValueError: another source never stands in, as it may cost money."""
    if (source, kind) in FEEDS:
        return FEEDS[source, kind]
    kinds = sorted(k for s, k in FEEDS if s == source)
    if kinds:
        raise ValueError(f"{source} has no {kind!r}, but {', '.join(kinds)}")
    raise ValueError(f"unknown source {source!r}; there are {', '.join(sorted({s for s, _ in FEEDS}))}")


def ticks_schema() -> T.StructType:
    """symbol, ts, source, kind, seq and the columns of all feeds, by name."""
    columns = {name: kind for f in FEEDS.values() for name, kind in f.columns.items()}
    return T.StructType.fromDDL("symbol string, ts timestamp_ntz, source string, kind string, seq long, " + ", ".join(f"{n} {k}" for n, k in columns.items()))


def as_ticks(raw: DataFrame, source: str, kind: str, zone: str = ZONE) -> DataFrame:
    """A source's rows as ticks: exchange-local time, the feed's columns by name and type, others null.

    `raw` has symbol and `timestamp` or ts: an instant, or a time without zone, which counts as UTC; and seq, if it tells the order
    of arrival. Columns that the feed lacks are dropped and those that the rows lack are null. Where only the last row of a time
    counts, seq says which that is, and then the values themselves. Rows without symbol or time are left out.
    """
    feed, time = feed_of(source, kind), "timestamp" if "timestamp" in raw.columns else "ts"
    zoneless = isinstance(raw.schema[time].dataType, T.TimestampNTZType)
    ts = F.convert_timezone(F.lit("UTC"), F.lit(zone), time) if zoneless else F.convert_timezone(F.current_timezone(), F.lit(zone), F.col(time).cast("timestamp_ntz"))
    made = {n: (F.col(n) if n in raw.columns else F.lit(None)).cast(k).alias(n) for n, k in (feed.columns | {"seq": "long"}).items()}
    rows = raw.select(F.upper("symbol").alias("symbol"), ts.alias("ts"), *made.values()).na.drop(subset=["symbol", "ts"])
    rows = last_of_time(rows) if feed.one_a_time else rows
    named = rows.withColumns({"source": F.lit(source), "kind": F.lit(kind)})
    return named.select(*((F.col(f.name) if f.name in named.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in ticks_schema()))


def last_of_time(rows: DataFrame, *more: str) -> DataFrame:
    """One row for each symbol and time (and `more` columns): the last by seq, then by values, nulls before others."""
    values = [c for c in rows.columns if c not in ("symbol", "ts", *more)]
    last = F.max_by(F.struct(*values), F.struct("seq", *values))
    return rows.groupBy("symbol", "ts", *more).agg(last.alias("_last")).select("symbol", "ts", *more, *(F.col(f"_last.{v}").alias(v) for v in values))


def get_ticks(spark: SparkSession, root: str, symbols: list[str], start: str, end: str, source: str = "alpaca", kind: str = "trades", zone: str = ZONE) -> DataFrame:
    """Ticks of some symbols from `start` to `end`, exchange-local, both included, out of the source's files in root/source/kind.

    Times and symbols are filters on the files' own columns, so they reach the scan.
    """
    feed_of(source, kind)
    raw = spark.read.parquet(f"{root}/{source}/{kind}")
    time = "timestamp" if "timestamp" in raw.columns else "ts"
    instants = [datetime.fromisoformat(t).replace(tzinfo=ZoneInfo(zone)).astimezone(timezone.utc) for t in (start, end)]
    zoneless = isinstance(raw.schema[time].dataType, T.TimestampNTZType)
    first, last = (F.lit(t.replace(tzinfo=None)).cast("timestamp_ntz") if zoneless else F.lit(t) for t in instants)
    wanted = raw.where(F.col("symbol").isin([s.upper() for s in symbols]) & (F.col(time) >= first) & (F.col(time) <= last))
    return as_ticks(wanted, source, kind, zone)
