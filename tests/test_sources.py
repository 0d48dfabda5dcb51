"""Providers, feeds and stores: chunks, gaps, switches, odd rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.functions import files
from barloom.sources import feeds, fixtures, provider, store

SF = "/root/testdata/sf0.001"
RAW = "ts timestamp_ntz, Open double, High double, Low double, Close double, Volume long, symbol string, interval string, extra string"


def archive(spark, path, rows):
    spark.createDataFrame([(t, c, c, c, c, 1, s, "1m", "x") for s, t, c in rows], RAW).write.partitionBy("interval", "symbol").parquet(path)


def at(day, hour=15, minute=0):
    return dt.datetime(2024, 1, 1, hour, minute) + dt.timedelta(days=day - 1)


def test_history_by_chunks(spark, tmp_path):
    """Times outside of what is kept, the first and last of a chunk, a null price, a time that comes twice, an unknown symbol."""
    path, until = str(tmp_path / "a"), dt.date(2024, 2, 10)
    rows = [("A", at(10, 23, 59), 1.0), ("A", at(11, 0), 2.0), ("A", at(18, 0), 3.0), ("A", at(18, 0), 4.0), ("A", at(40, 23, 59), 5.0), ("A", at(41, 0), 6.0), ("B", at(12), None), ("B", at(13), 7.0)]
    archive(spark, path, rows)
    got = provider.fetch_max_available(spark, path, "1m", until=until)
    assert got.schema == store.BARS
    made = sorted((r.symbol, r.ts, r.close) for r in got.collect() if r.close is not None)
    assert [m[:2] for m in made] == [("A", at(10, 19)), ("A", at(17, 19)), ("A", at(40, 18, 59)), ("B", at(13, 10))]
    assert made[1][2] in (3.0, 4.0) and made[2][2] == 5.0
    assert got.where("symbol = 'B'").count() == 2
    assert provider.fetch_max_available(spark, path, "1m", ["a"], until).select("symbol").distinct().collect()[0].symbol == "A"
    with pytest.raises(store.DataFetchError, match="NONE"):
        provider.fetch_max_available(spark, path, "1m", ["A", "none"], until)
    assert provider.fetch_max_available(spark, path, "1m", ["NONE"], until, strict=False).count() == 0
    with pytest.raises(ValueError, match="2m"):
        provider.fetch_max_available(spark, path, "2m")


def test_filters_reach_the_provider(spark, tmp_path):
    path, until = str(tmp_path / "a"), dt.date(2024, 2, 10)
    archive(spark, path, [(s, at(d), float(d)) for s in "ABC" for d in range(11, 40)])
    options = {"path": path, "interval": "1m", "until": until.isoformat()}
    assert len(provider.ProviderReader(options).partitions()) == 3 * 5
    some = provider.fetch_max_available(spark, path, "1m", until=until).where("symbol in ('A', 'C') and ts >= timestamp_ntz'2024-01-20 00:00:00' and ts < timestamp_ntz'2024-01-22 00:00:00'")
    assert sorted((r.symbol, r.close) for r in some.collect()) == [("A", 20.0), ("A", 21.0), ("C", 20.0), ("C", 21.0)]
    reader = provider.ProviderReader(options)
    left = list(reader.pushFilters([provider.In(("symbol",), ["A", "C"]), provider.GreaterThanOrEqual(("ts",), dt.datetime(2024, 1, 20)), provider.LessThan(("ts",), dt.datetime(2024, 1, 22))]))
    assert len(left) == 2 and [(r.symbol, r.chunk) for r in reader.partitions()] == [("A", 1), ("C", 1)]
    assert not list(provider.ProviderReader(options).pushFilters([provider.EqualTo(("interval",), "1m")]))
    reader = provider.ProviderReader(options)
    list(reader.pushFilters([provider.EqualTo(("interval",), "1d")]))
    assert reader.partitions() == []
    rows = some._jdf.queryExecution().executedPlan()
    assert "IN (A,C)" not in rows.toString()  # the source has taken the symbols over; times are looked at again


def test_feeds_by_name(spark):
    raw = spark.createDataFrame([("a", at(2), 1, 5, "X", "more"), ("a", at(2), 2, 6, None, "more"), ("b", None, 3, 7, "X", ""), (None, at(2), 4, 8, "X", "")], "symbol string, timestamp timestamp_ntz, seq long, price int, exchange string, tape string")
    got = feeds.as_ticks(raw, "alpaca", "trades").collect()
    assert [(r.symbol, r.ts, r.price, r.size, r.exchange, r.bid_price, r.source) for r in got] == [("A", at(2, 10), 6.0, None, None, None, "alpaca")]
    assert feeds.as_ticks(raw, "databento", "trades").count() == 2  # all rows of a time
    assert feeds.as_ticks(raw.limit(0), "alpaca", "quotes").count() == 0
    for source, kind, says in (("alpaca", "bars", "quotes, trades"), ("databento", "quotes", "trades"), ("other", "trades", "unknown source")):
        with pytest.raises(ValueError, match=says):
            feeds.feed_of(source, kind)


def test_second_run_fetches_gaps_only(spark, tmp_path):
    path, asked = str(tmp_path / "t"), []
    raw = spark.createDataFrame([("A", at(d), k, float(d)) for d in (2, 3, 5, 6, 7) for k in (1, 2)], "symbol string, timestamp timestamp_ntz, seq long, price double")
    raw.withColumn("day", F.to_date("timestamp")).write.partitionBy("day").parquet(str(tmp_path / "feed"))

    def fetch(days):
        asked.append(sorted(r.date.day for r in days.collect()))
        some = spark.read.parquet(str(tmp_path / "feed")).join(days.select(F.col("date").alias("day")), "day", "left_semi")
        assert "dynamicpruning" in some._jdf.queryExecution().toString()  # other days' files aren't read
        return feeds.as_ticks(some, "alpaca", "trades")

    ask = lambda a, b, **more: sorted((r.ts.day, r.seq) for r in store.get_ticks_cached(spark, path, fetch, ["a"], at(a).date(), at(b).date(), today=at(7).date(), **more).collect())
    assert ask(3, 5) == [(3, 2), (5, 2)] and asked == [[3, 4, 5]]
    assert ask(2, 6) == [(2, 2), (3, 2), (5, 2), (6, 2)] and asked[1:] == [[2, 6]]  # the fourth has no tick but was asked for
    assert ask(3, 6) and len(asked) == 2
    assert ask(6, 8) == [(6, 2), (7, 2)] and asked[2:] == [[7, 8]]
    assert ask(6, 7, refresh_today=False) == [(6, 2), (7, 2)] and asked[3:] == [[7]]  # today was never kept
    assert ask(5, 4) == []
    kept = store.read_ticks(spark, path, ["A"], at(3).date(), at(3).date(), "alpaca", "trades")
    assert "PartitionFilters: [isnotnull(source" in kept._jdf.queryExecution().toString() and {r.date.day for r in kept.collect()} == {3}


def bars(spark, rows):
    frame = spark.createDataFrame([(s, "1h", at(d), c, c, c, c, 1.0) for s, d, c in rows], store.BARS)
    return frame.withColumn("more", F.lit(1))


def closes(spark, path):
    return sorted((r.symbol, r.ts.day, r.close) for r in store.read_bars(spark, path).collect())


def test_emptied_partitions_are_gone(spark, tmp_path):
    path = str(tmp_path / "b")
    assert closes(spark, path) == []
    store.save_bars(spark, path, bars(spark, []))
    assert closes(spark, path) == []
    store.save_bars(spark, path, bars(spark, [("A", 1, 1.0), ("A", 2, 2.0), ("B", 1, 3.0), (None, 1, 9.0)]))
    store.save_bars(spark, path, bars(spark, [("A", 1, None), ("A", 2, None), ("C", 1, 4.0)]))
    assert closes(spark, path) == [("B", 1, 3.0), ("C", 1, 4.0)]
    table = store.bars_table(spark, path)
    assert len(table.vacuum()) == 0  # B is still read from the first version
    store.save_bars(spark, path, bars(spark, [("B", 1, 5.0)]))
    assert len(store.bars_table(spark, path).vacuum()) == 1
    assert closes(spark, path) == [("B", 1, 5.0), ("C", 1, 4.0)]


def test_a_write_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "b")
    store.save_bars(spark, path, bars(spark, [("A", 1, 1.0)]))
    reader = store.read_bars(spark, path)
    monkeypatch.setattr(files, "put", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.save_bars(spark, path, bars(spark, [("A", 1, 2.0), ("B", 1, 2.0)]))
    assert closes(spark, path) == [("A", 1, 1.0)]
    monkeypatch.undo()
    store.save_bars(spark, path, bars(spark, [("A", 1, 3.0)]))
    assert closes(spark, path) == [("A", 1, 3.0)] and [r.close for r in reader.collect()] == [1.0]  # who began to read before still can


def test_days_count_by_series(spark):
    some = bars(spark, [("A", 1, 1.0), ("A", 2, 1.0), ("B", 1, 1.0)])
    from barloom.operators import frames

    assert frames.require_days(some, 1).count() == 3
    with pytest.raises(frames.InsufficientHistoryError, match="1 trading days, 2 needed"):
        frames.require_days(some, 2)
    with pytest.raises(frames.InsufficientHistoryError):
        frames.require_days(some.limit(0), 1)


def test_archives_of_the_events(spark):
    root = fixtures.feed_archive(spark, SF)
    plan = feeds.get_ticks(spark, root, ["S1"], "2024-01-03 00:00:00", "2024-01-04 00:00:00", "databento", "trades")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(symbol" in plan.replace("IsNotNull(symbol), ", "") or "EqualTo(symbol,S1)" in plan
    assert "GreaterThanOrEqual(timestamp," in plan and "<= 2024-01-04 05:00:00" in plan
