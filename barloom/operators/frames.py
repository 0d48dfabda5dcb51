"""Bars in order: sessions, numbering, resampling, levels of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import keys, ratio, series, upto

OHLCV = ("open", "high", "low", "close", "volume")


class InsufficientHistoryError(ValueError):
    """Fewer trading days, or symbols that have enough of them, than asked for."""

    def __init__(self, have: int, need: int, of: str = "trading days"):
        super().__init__(f"{have} {of}, {need} needed")
        self.have, self.need = have, need


def prepared(bars: DataFrame) -> DataFrame:
    """session_date and bar_idx (from 0 in each series)."""
    return bars.withColumn("session_date", F.to_date("ts")).withColumn("bar_idx", (F.row_number().over(series(bars)) - 1).cast("long"))


def check_bars(bars: DataFrame) -> DataFrame:
    """The bars, if they have the five columns and a time; else ValueError."""
    missing = [c for c in (*OHLCV, "ts") if c not in bars.columns]
    if missing:
        raise ValueError(f"bars without {', '.join(missing)}")
    return bars


def check_series(bars: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """The keys of each series and `error`: why no back-test can run on it, or null. `wanted` names series that must be there.

    A series has bars, all five values in each, and no time twice. Where rows have `seq`, the order in which they came, times
    must ascend with it.
    """
    per = keys(bars)
    lacks = {c: F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))) for c in OHLCV}
    facts = bars.groupBy(*per).agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct("ts")).alias("twice"), *(v.alias(f"no_{c}") for c, v in lacks.items()))
    if "seq" in bars.columns:
        back = F.col("ts") < F.lag("ts").over(Window.partitionBy(*per).orderBy("seq"))
        facts = facts.join(bars.withColumn("_back", back).groupBy(*per).agg(F.count_if("_back").alias("back")), per)
    if wanted is not None:
        facts = wanted.select(*per).distinct().join(facts, per, "left").unionByName(facts.join(wanted, per, "left_anti"))
    reasons = [F.when(F.col("n").isNull(), F.lit("no bars"))]
    reasons += [F.when(F.col(f"no_{c}") > 0, F.concat(F.lit(f"{c} missing in "), F.col(f"no_{c}").cast("string"), F.lit(" bars"))) for c in OHLCV]
    reasons += [F.when(F.col("twice") > 0, F.concat(F.lit("times repeated in "), F.col("twice").cast("string"), F.lit(" bars")))]
    reasons += [F.when(F.col("back") > 0, F.concat(F.lit("times go back in "), F.col("back").cast("string"), F.lit(" bars")))] if "seq" in bars.columns else []
    error = F.concat_ws("; ", *reasons)
    return facts.select(*per, F.when(error != "", error).alias("error"))


def drop_bad_rows(bars: DataFrame) -> DataFrame:
    """Rows with all five values; NaN counts as missing."""
    clean = bars.withColumns({c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in OHLCV})
    return clean.na.drop(subset=list(OHLCV))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace old ones of the same time; only then do incomplete rows go, so an empty update deletes."""
    both = old.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)))
    newest = Window.partitionBy(*keys(old), "ts").orderBy(F.desc("_seq"))
    kept = both.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_seq", "_rn")
    return drop_bad_rows(kept)


def between(bars: DataFrame, start: str, end: str) -> DataFrame:
    """Rows from `start` to `end`, all of the day `end` if it is a date."""
    stop = F.lit(end).cast("timestamp_ntz")
    last = F.col("ts") < stop + F.expr("interval 1 day") if len(end) == 10 else F.col("ts") <= stop
    return bars.where((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & last)


def require_days(bars: DataFrame, need: int) -> DataFrame:
    """The bars, if every series in them has so many days; no bars are no days."""
    per = bars.groupBy(*keys(bars)).agg(F.countDistinct(F.to_date("ts")).alias("days"))
    have = per.agg(F.coalesce(F.min("days"), F.lit(0))).first()[0]
    if have < need:
        raise InsufficientHistoryError(have, need)
    return bars


def resample_daily(bars: DataFrame) -> DataFrame:
    per = [k for k in keys(bars)]
    return bars.groupBy(*per, F.to_date("ts").alias("session_date")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"),
    )


def bar_minutes(bars: DataFrame) -> DataFrame:
    """The most frequent spacing of each series, the least of equals, 1 without any."""
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(series(bars)).cast("timestamp"))) / 60e6
    return bars.withColumn("_gap", gap).groupBy(*keys(bars)).agg(F.coalesce(F.mode(F.when(F.col("_gap") > 0, F.col("_gap")), True), F.lit(1.0)).alias("bar_minutes"))


def with_bar_minutes(bars: DataFrame) -> DataFrame:
    return bars.join(bar_minutes(bars), keys(bars))


def forward_return(bars: DataFrame, ahead: int = 10) -> DataFrame:
    return bars.withColumn("forward_return", ratio(F.lead("close", ahead).over(series(bars)), "close") - 1)


def opening_range(bars: DataFrame, minutes: float = 15) -> DataFrame:
    """or_high and or_low of each session's first bars, on all of its rows. Half bars round to even."""
    bars = with_bar_minutes(bars).withColumn("session_date", F.to_date("ts"))
    first = F.greatest(F.lit(1), F.bround(F.lit(float(minutes)) / F.col("bar_minutes"), 0).cast("int"))
    day = Window.partitionBy(*keys(bars), "session_date")
    bars = bars.withColumn("_rn", F.row_number().over(series(bars, "session_date")))
    early = F.col("_rn") <= first
    return bars.withColumns({"or_high": F.max(F.when(early, F.col("high"))).over(day), "or_low": F.min(F.when(early, F.col("low"))).over(day)}).drop("_rn", "bar_minutes")


def session_vwap(bars: DataFrame) -> DataFrame:
    """Volume-weighted typical price since the session's start; carried on, over sessions too, while there is no volume."""
    bars = bars.withColumn("session_date", F.to_date("ts"))
    day = upto(series(bars, "session_date"))
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    bars = bars.withColumn("_vwap", ratio(F.sum(typical * F.col("volume")).over(day), F.sum("volume").over(day)))
    return bars.withColumn("vwap", F.last("_vwap", ignorenulls=True).over(upto(series(bars)))).drop("_vwap")
