"""Mixing sources to target weights by balanced sampling with the cube method.

A source's target over its size is a whole number of passes plus a fraction; the fraction is every document's inclusion
probability. The flight phase moves those probabilities along vectors of the null-space of two constraints (words and
documents of the source), so both totals stay as they are while probabilities reach 0 or 1. It runs in blocks of one
source; what two constraints leave open in each block, and a few documents of various sizes that it keeps back, meet again
in further rounds until each source has one block, and the landing settles its last fourteen documents at least cost.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, documents, materialize

BLOCK, LANDING = 2048, 12
CAP = 3.0
SCHEMA = "doc_id long, key long, row long, size long, source_no long, source_size long, target double, passes long, x double"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = CAP) -> DataFrame:
    """source, source_no (from 0 by code point, null last), source_docs, source_size, target.

    Targets share all sizes by weight and stop at `cap` times a source's size, where the rest is shared on. With sources
    in order of cap * size / weight the stopped ones come first: the level is the first at which the next isn't stopped.
    The table has a row per source, after aggregation, so its one sorted window is short.
    """
    per = sized.groupBy("source").agg(F.count("*").alias("source_docs"), F.sum("size").alias("source_size"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("source_no", F.row_number().over(order) - 1)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int")).cast("double")
    per = per.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(cap))
    per = per.withColumn("ratio", F.col("most") / F.col("w"))
    whole = Window.partitionBy(F.lit(0))
    up = whole.orderBy("ratio", "source_no").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("level", F.try_divide(
        F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(up), F.lit(0.0)),
        F.sum("w").over(whole) - F.coalesce(F.sum("w").over(up), F.lit(0.0)),
    ))
    level = F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(
        whole.orderBy("ratio", "source_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    target = F.least(F.col("most"), F.coalesce(level * F.col("w"), F.lit(0.0)))
    return per.select("source", F.col("source_no").cast("long"), "source_docs", "source_size", target.alias("target"))


def flight(x: np.ndarray, sizes: np.ndarray, seed: int, tiny: float = 1e-9) -> np.ndarray:
    """Move probabilities, three documents at a time, along the null-space of (words, documents)."""
    x, s, draw = x.tolist(), sizes.tolist(), np.random.default_rng(seed)
    open_, chance, c = [], iter(()), 0
    for i in range(len(x)):
        if tiny < x[i] < 1 - tiny:
            open_.append(i)
        else:
            x[i] = float(round(x[i]))
        if len(open_) < 3:
            continue
        a, b, c = open_
        u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
        if not any(u):
            u = (1, -1, 0)
        ahead = back = float("inf")
        for k, v in zip(open_, u, strict=True):
            if v:
                up, down = ((1 - x[k]) / v, x[k] / v) if v > 0 else (x[k] / -v, (1 - x[k]) / -v)
                ahead, back = min(ahead, up), min(back, down)
        t = next(chance, None)
        if t is None:
            chance = iter(draw.random(512).tolist())
            t = next(chance)
        step = ahead if t * (ahead + back) < back else -back
        for k, v in zip(open_, u, strict=True):
            x[k] += step * v
        still = []
        for k in open_:
            if tiny < x[k] < 1 - tiny:
                still.append(k)
            else:
                x[k] = float(round(x[k]))
        open_ = still if len(still) < 3 else still[1:]  # rounding kept all three open: the first waits for the next round
    return np.array(x)


def land(x: np.ndarray, sizes: np.ndarray, tiny: float = 1e-9) -> np.ndarray:
    """Settle the few open documents: of all ways, the one that misses words, then documents, by the least."""
    x = x.copy()
    at = np.flatnonzero((x > tiny) & (x < 1 - tiny))
    if len(at):
        ways = (np.arange(1 << len(at))[:, None] >> np.arange(len(at)) & 1).astype(np.float64)
        words, docs = np.abs(ways @ sizes[at] - x[at] @ sizes[at]), np.abs(ways.sum(1) - x[at].sum())
        x[at] = ways[np.lexsort((docs, words))[0]]
    return np.round(x)


def weights_of(sizes: np.ndarray, kept: int) -> np.ndarray:
    """Documents whose sizes add up to every total within their reach, as far as there are such: each the largest that is
    at most one more than all before it together, or else the smallest left."""
    order, reach, chosen = np.argsort(sizes, kind="stable").tolist(), 0.0, []
    while order and len(chosen) < kept:
        k = int(np.searchsorted(sizes[order], reach + 1, "right"))
        chosen.append(order.pop(max(k - 1, 0)))
        reach += sizes[chosen[-1]]
    return np.array(chosen, int)


def move(x: np.ndarray, sizes: np.ndarray, seed: int, kept: int, last: bool) -> np.ndarray:
    """The flight of a block. Up to `kept` of its open documents sit it out, so that the landing of the last block of a source
    has some of all sizes and can be exact."""
    open_ = np.flatnonzero((x > 0) & (x < 1))
    rest = np.setdiff1d(np.arange(len(x)), open_[weights_of(sizes[open_], kept)])
    x = x.copy()
    x[rest] = flight(x[rest], sizes[rest], seed)
    return land(x, sizes) if last else x


def reserve(block: int) -> int:
    """Documents of a block that sit a round out; the next round has at most a few for each block of this."""
    return min(LANDING, block // 4)


def settle(number: int, block: int):
    """The work of a round on one block of one source; the last round's only block also lands."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "row", "size"], kind="stable")
        sizes, first = pdf["size"].to_numpy(np.float64), pdf.iloc[0]
        seed, last = int(first["source_no"]) * 1000003 + int(first["block"]) * 31 + number, bool(first["last"])
        return pdf.assign(x=move(pdf["x"].to_numpy(np.float64), sizes, seed, LANDING if last else reserve(block), last))[COLUMNS]

    return run


def blocks_of(source_docs: Column, number: int, block: int) -> Column:
    """Blocks of a source in a round: each block before it left a reserve and two documents open."""
    out = F.ceil(source_docs / block)
    for _ in range(number):
        out = F.when(out <= 1, 1).otherwise(F.ceil((2 + reserve(block)) * out / block))
    return F.greatest(out, F.lit(1)).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = CAP, block: int = BLOCK,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, row for every row of `docs`.

    size: words of the text (null: 0); null is a source of its own, the last. taken is size times copies, and copies is
    the passes of the source or one more, at most `cap`. A source without words has target 0 and copies 0. Repeated rows
    are documents of their own: equal ones are counted first and then numbered, so that a row's draws are hashed from what
    it holds and its number among its equals, reruns agree, and no block gets all copies of one row. Other columns are not
    read; `row` names the rows equal to this in id, text and source, or in what `row_col` says.
    """
    known = F.xxhash64(*map(F.col, dict.fromkeys((id_col, text_col, source_col)))) if row_col is None else F.col(row_col)
    counted = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), known.alias("key"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    ).groupBy("doc_id", "source", "key", "size").agg(F.count("*").alias("times"))
    sized = materialize(counted.withColumn("number", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("times"))
    targets = materialize(source_targets(sized, weights, cap))
    share = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    rows = (
        sized.join(targets, sized["source"].eqNullSafe(targets["source"]))
        .withColumn("share", share)
        .select(
            "doc_id", "key", F.xxhash64("key", "number").alias("row"), "size", "source_no", "source_size", "target",
            F.floor("share").cast("long").alias("passes"), (F.col("share") - F.floor("share")).alias("x"),
            blocks_of(F.col("source_docs"), 0, block).alias("blocks"),
        )
    )
    most = targets.agg(F.max("source_docs")).first()[0] or 0
    settled, number = [], 0
    blocks = max(1, -(-most // block))
    while True:
        dealt = rows.withColumn("at", F.xxhash64("row", F.lit(number))).withColumn("last", F.col("blocks") <= 1)
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("row", F.lit(1000 + number)), F.col("blocks")))
        made = materialize(dealt.groupBy("source_no", "block").applyInPandas(settle(number, block), SCHEMA)
                           .join(targets.select("source_no", "source_docs"), "source_no"))
        whole = F.col("x").isin(0.0, 1.0)
        settled.append(made.where(whole))
        if blocks <= 1:
            break
        # a block leaves fourteen documents open, so the next round has fewer by two orders of magnitude
        number, blocks = number + 1, -(-(2 + reserve(block)) * blocks // block)
        rows = made.where(~whole).withColumn("blocks", blocks_of(F.col("source_docs"), number, block)).drop("source_docs")
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    copies = F.when(F.col("source_size") > 0, F.col("passes") + F.col("x").cast("long")).otherwise(0)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), F.col("key").alias("row"))


def op10(spark, sf_dir):
    """The mix of all rows of `documents`; null and empty texts have size 0, and repeated rows are taken each by itself."""
    return mix(documents(spark, sf_dir, "doc_id", "text", "source")).drop("row")
