"""A provider's history of bars as a Spark data source: one partition to a request.

A provider keeps so many days of an interval and answers requests of so many. The source plans a request for each symbol and
chunk, leaves out those that pushed filters exclude, and each task makes its own: here from an archive of the provider's files,
in folders interval=.../symbol=..., with its names of columns and times in UTC.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import date, datetime, time, timedelta, timezone

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..functions import files
from ..operators.frames import OHLCV
from .store import BARS, LOOKBACK_DAYS, RENAMED, DataFetchError, chunks

FORMAT, ZONE = "provider_bars", "America/New_York"
ROWS = "symbol string, interval string, ts timestamp_ntz, open double, high double, low double, close double, volume double, chunk int, seq long"
ARROW = pa.schema([("symbol", pa.string()), ("interval", pa.string()), ("ts", pa.timestamp("us")), *((c, pa.float64()) for c in OHLCV), ("chunk", pa.int32()), ("seq", pa.int64())])
DAY = timedelta(days=1)


@dataclass
class Request(InputPartition):
    symbol: str
    chunk: int
    start: date
    end: date  # not included


class ProviderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.interval, self.zone = options["path"].rstrip("/"), options["interval"], options.get("zone", ZONE)
        if self.interval not in LOOKBACK_DAYS:
            raise ValueError(f"unknown interval {self.interval!r}; there are {', '.join(LOOKBACK_DAYS)}")
        self.until = date.fromisoformat(options["until"]) if "until" in options else datetime.now(timezone.utc).date()
        self.symbols = options["symbols"].split("\n") if "symbols" in options else [n.removeprefix("symbol=") for n in files.names(f"{self.path}/interval={self.interval}") if n.startswith("symbol=")]
        self.first, self.last, self.nothing = datetime.min, datetime.max, False

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Symbols and intervals are taken over; of times only whole requests, so rows are still looked at."""
        for f in filters:
            name, value = getattr(f, "attribute", ("",))[-1], getattr(f, "value", None)
            if isinstance(f, (EqualTo, In)) and name in ("symbol", "interval"):
                values = set(value) if isinstance(f, In) else {value}
                if name == "symbol":
                    self.symbols = [s for s in self.symbols if s in values]
                else:
                    self.nothing |= self.interval not in values
                continue
            if name == "ts" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.first = max(self.first, value)
            if name == "ts" and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.last = min(self.last, value)
            yield f

    def partitions(self) -> list[Request]:
        """A request for each chunk and symbol. The exchange's clock is within a day of UTC."""
        if self.nothing:
            return []
        days = [(k, a, b, datetime.combine(a, time()), datetime.combine(b, time())) for k, (a, b) in enumerate(chunks(self.interval, self.until))]
        wanted = [(k, a, b) for k, a, b, begin, end in days if end + DAY > self.first and begin - DAY <= self.last]
        return [Request(s, k, a, b) for s in self.symbols for k, a, b in wanted]

    def read(self, partition: Request) -> Iterator[pa.RecordBatch]:
        """The rows of one request; a chunk without any, or a symbol that the provider doesn't have, gives none."""
        where, path = files.place(f"{self.path}/interval={self.interval}/symbol={partition.symbol}")
        if not files.exists(f"{self.path}/interval={self.interval}/symbol={partition.symbol}"):
            return
        found = ds.dataset(path, filesystem=where, format="parquet")
        names = {RENAMED.get(n, n): n for n in found.schema.names}
        missing = [c for c in (*OHLCV, "ts") if c not in names]
        if missing:
            raise DataFetchError(f"{partition.symbol}: missing columns {', '.join(missing)}")
        kind, ts, seq = found.schema.field(names["ts"]).type, pc.field(names["ts"]), 0
        at = [pa.scalar(datetime.combine(d, time(), timezone.utc if kind.tz else None), kind) for d in (partition.start, partition.end)]
        for batch in found.to_batches(columns=[names[c] for c in ("ts", *OHLCV)], filter=(ts >= at[0]) & (ts < at[1])):
            times = pc.cast(batch.column(0), pa.timestamp("us", "UTC")) if kind.tz else pc.assume_timezone(pc.cast(batch.column(0), pa.timestamp("us")), "UTC")
            local = pc.local_timestamp(pc.cast(times, pa.timestamp("us", self.zone)))
            n = batch.num_rows
            values = [pc.cast(c, pa.float64()) for c in batch.columns[1:]]
            yield pa.record_batch([pa.array([partition.symbol] * n, pa.string()), pa.array([self.interval] * n, pa.string()), local, *values,
                                   pa.array([partition.chunk] * n, pa.int32()), pa.array(range(seq, seq + n), pa.int64())], schema=ARROW)
            seq += n


class ProviderBars(DataSource):
    """Format provider_bars. Options: path, interval, until (a date, today), symbols (one a line; all), zone. `chunk` and `seq` tell the
    order in which rows came."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> ProviderReader:
        return ProviderReader(dict(self.options))


def fetch_max_available(spark: SparkSession, path: str, interval: str = "1m", symbols: list[str] | None = None, until: date | None = None, zone: str = ZONE, strict: bool = True) -> DataFrame:
    """All bars that the provider keeps of an interval, one to a symbol and time: the last that came, chunk by chunk.

    Filters on symbol, interval and ts of what is returned reach the source. Empty chunks are left out. With `strict`, symbols
    that are asked for and have no bar at all are a DataFetchError. Nulls stay; an unknown interval is a ValueError.
    """
    if interval not in LOOKBACK_DAYS:
        raise ValueError(f"unknown interval {interval!r}; there are {', '.join(LOOKBACK_DAYS)}")
    spark.dataSource.register(ProviderBars)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format(FORMAT).option("interval", interval).option("zone", zone)
    reader = reader.option("until", until.isoformat()) if until else reader
    rows = (reader.option("symbols", "\n".join(s.upper() for s in symbols)) if symbols else reader).load(path)
    if strict and symbols:
        have = {r.symbol for r in rows.select("symbol").distinct().collect()}  # no more than were asked for
        if set(map(str.upper, symbols)) - have:
            raise DataFetchError(f"no {interval} bars of {', '.join(sorted(set(map(str.upper, symbols)) - have))} in the last {LOOKBACK_DAYS[interval]} days")
    last = F.max_by(F.struct(*OHLCV), F.struct("chunk", "seq")).alias("bar")
    return rows.groupBy("symbol", "interval", "ts").agg(last).select("symbol", "interval", "ts", *(F.col(f"bar.{c}").alias(c) for c in OHLCV)).select(*BARS.names)
