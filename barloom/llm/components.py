"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _stars(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours, and then its smaller ones and itself, hang on the least node around it."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    down = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(down, "u")
    return small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, root: the least node of its component, for each node that `edges` (u, v) names and that isn't the root.

    Links may repeat, point either way or join a node to itself; nulls are left out. Rounds grow with the logarithm of
    the longest path; each is written to the shared folder. Raises RuntimeError if `most` rounds don't settle.
    """
    flip = F.col("u") < F.col("v")
    edges = edges.where("u <> v").select(F.when(flip, F.col("v")).otherwise(F.col("u")).alias("u"), F.when(flip, F.col("u")).otherwise(F.col("v")).alias("v"))
    edges = materialize(edges.distinct())
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    seen = mark(edges)
    for _ in range(most):
        if not seen[0]:
            break
        edges = materialize(_stars(edges))
        now = mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
