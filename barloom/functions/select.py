"""Exact quantiles of groups that needn't fit into one task.

Values are dealt to slices by range, which are counted; counts of the slices before tell in which slice the wanted places are,
and only these slices are numbered. So no task sees more of a group than a slice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import materialize


def quantiles(df: DataFrame, by: list[str], columns: list[str], q: float = 0.5) -> DataFrame:
    """`by` and, under their names, the q-quantile of each of `columns`: interpolated between the two nearest, nulls and NaN not
    counted, null for a group without values. Groups are those with a value in some column; keys may not be null."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("column"), F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias("value")) for k, c in enumerate(columns))))
    long = df.select(*by, each.alias("one")).select(*by, "one.*").where("value is not null").withColumn("row", F.monotonically_increasing_id())
    group = [*by, "column"]
    cut = materialize(long.repartitionByRange(*group, "value", "row").drop("row").withColumn("slice", F.spark_partition_id()))
    counts = materialize(cut.groupBy(*group, "slice").agg(F.count("*").alias("n")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = (F.col("total") - 1) * F.lit(float(q))
    slices = counts.withColumn("before", before).join(counts.groupBy(*group).agg(F.sum("n").alias("total")), group)
    slices = slices.withColumns({"place": place, "low": F.floor(place), "high": F.ceil(place)})
    holds = lambda k: (F.col("before") <= F.col(k)) & (F.col(k) < F.col("before") + F.col("n"))
    there = cut.join(slices.where(holds("low") | holds("high")).drop("n", "total"), [*group, "slice"])
    rank = F.col("before") + F.row_number().over(Window.partitionBy(*group, "slice").orderBy("value")) - 1
    ends = there.withColumn("rank", rank).where("rank = low or rank = high").groupBy(*group).agg(
        F.min("value").alias("a"), F.max("value").alias("b"), F.max("place").alias("place"), F.max("low").alias("low"), F.max("high").alias("high"))
    value = F.when(F.col("low") == F.col("high"), F.col("a")).otherwise((F.col("high") - F.col("place")) * F.col("a") + (F.col("place") - F.col("low")) * F.col("b"))
    return ends.withColumn("value", value).groupBy(*by).agg(*(F.max(F.when(F.col("column") == k, F.col("value"))).alias(c) for k, c in enumerate(columns)))


def with_medians(df: DataFrame, by: list[str], medians: dict[str, str]) -> DataFrame:
    """The rows with the median of their group under each name of `medians` (name: column)."""
    one, by = (df.withColumn("_all", F.lit(1)), ["_all"]) if not by else (df, by)
    found = quantiles(one, by, list(medians.values()))
    return one.join(found.select(*by, *(F.col(c).alias(n) for n, c in medians.items())), by, "left").select(*df.columns, *medians)
