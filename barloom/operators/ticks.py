"""Trades and quotes: as-of matching, order-flow features by time bucket, and how they rank later returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import average_rank, correlation, ratio

C = F.col
FEATURES = ("order_flow_imbalance", "quote_imbalance", "relative_spread")


def classify_side(trades: DataFrame, quotes: DataFrame, slice_: str = "1 day") -> DataFrame:
    """Trades with mid (of the last quote at or before, the last read of one instant) and side: the sign of price against mid,
    at the mid that of the price's change. Without a quote, or with one that lacks a price, the side is null.

    Rows of a symbol are split by time slices, so a busy symbol is no single task: within a slice the last quote is a
    window; what was last before a slice comes from a small table with a row for each slice.
    """
    part = F.window("ts", slice_)["start"]
    t = trades.select("*", F.lit(1).alias("_kind"), F.lit(None).cast("struct<v:double>").alias("_mid"), part.alias("_slice"))
    q = quotes.select("symbol", "ts", F.lit(0).alias("_kind"), F.struct(((C("bid_price") + C("ask_price")) / 2).alias("v")).alias("_mid"), part.alias("_slice"))
    both = t.unionByName(q, allowMissingColumns=True)
    inside = Window.partitionBy("symbol", "_slice").orderBy("ts", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    before = inside.orderBy("ts", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    price = F.when(C("_kind") == 1, C("price"))
    both = both.withColumns({"_m": F.last("_mid", True).over(inside), "_p": F.last(price, True).over(before)})
    ends = both.groupBy("symbol", "_slice").agg(
        F.max_by("_mid", F.when(C("_mid").isNotNull(), F.struct("ts", "_kind"))).alias("_em"), F.max_by(price, F.when(price.isNotNull(), F.struct("ts", "_kind"))).alias("_ep"),
    )
    earlier = Window.partitionBy("symbol").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("symbol", "_slice", F.last("_em", True).over(earlier).alias("_sm"), F.last("_ep", True).over(earlier).alias("_sp"))
    out = both.where("_kind = 1").join(ends, ["symbol", "_slice"]).withColumns({"mid": F.coalesce("_m", "_sm")["v"], "_prev": F.coalesce("_p", "_sp")})
    side = F.signum(C("price") - C("mid"))
    tick = F.coalesce(F.signum(C("price") - C("_prev")), F.lit(0.0))
    return out.withColumn("side", F.when(side == 0, tick).otherwise(side)).select(*trades.columns, "mid", "side")


def features(trades: DataFrame, quotes: DataFrame, bucket: str = "15 minutes") -> DataFrame:
    """Per symbol and bucket; a side without rows leaves its columns null. Trades of unknown side count in the total."""
    at = F.window("ts", bucket)["start"].alias("bucket")
    t = classify_side(trades, quotes).groupBy("symbol", at).agg(
        ratio(F.coalesce(F.sum(C("side") * C("size")), F.lit(0.0)), F.sum("size")).alias("order_flow_imbalance"), F.count("*").alias("trade_count"), F.max_by("price", "ts").alias("close"),
    )
    q = quotes.groupBy("symbol", at).agg(
        F.avg(ratio(C("bid_size") - C("ask_size"), C("bid_size") + C("ask_size"))).alias("quote_imbalance"),
        F.avg(ratio(C("ask_price") - C("bid_price"), (C("ask_price") + C("bid_price")) / 2)).alias("relative_spread"), F.count("*").alias("quote_count"),
    )
    return t.join(q, ["symbol", "bucket"], "full_outer")


def validate(trades: DataFrame, quotes: DataFrame, bucket: str = "15 minutes", ahead: int = 1, least_trades: int = 5, least_quotes: int = 20, least: int = 10) -> DataFrame:
    """Rank correlation of each feature with the return over the next windows that aren't thin; null for few windows. n counts the windows of a feature, and
    n_windows those that have a price and a return."""
    f = features(trades, quotes, bucket).where((F.coalesce("trade_count", F.lit(0)) >= least_trades) & (F.coalesce("quote_count", F.lit(0)) >= least_quotes))
    f = f.withColumn("_r", ratio(F.lead("close", ahead).over(Window.partitionBy("symbol").orderBy("bucket")), "close") - 1)
    f = f.withColumn("n_windows", F.count(F.when(C("close").isNotNull() & C("_r").isNotNull(), 1)).over(Window.partitionBy("symbol")))
    long = f.select("symbol", "_r", "n_windows", F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), C(n).alias("value")) for n in FEATURES))).alias("x")).select("symbol", "_r", "n_windows", "x.*")
    long = long.where("_r is not null and value is not null")
    by = ["symbol", "feature"]
    long = long.withColumns({"_a": average_rank(C("value"), by), "_b": average_rank(C("_r"), by)})
    return long.groupBy(*by).agg(F.count("*").alias("n"), F.first("n_windows").alias("n_windows"), F.when(F.count("*") >= least, correlation(C("_a"), C("_b"))).alias("ic"))
