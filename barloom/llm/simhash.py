"""SimHash near-duplicates by pivot distance tables.

Each distinct fingerprint gets its Hamming distances to many reference fingerprints once. By the triangle inequality two
fingerprints whose distances to any reference differ by more than the limit can't link, so a pair is discarded by the
largest difference of its two rows, and only survivors are compared bit by bit.

Which pairs meet: fingerprints are cut into blocks, and all but `limit` of them are equal in any pair within the limit.
A pair meets where such a choice of blocks agrees, in order of the distance to the first reference, so a row meets only
those after it whose first distance is within the limit. A choice of blocks that very many fingerprints agree on is cut
into slices that meet two at a time in tasks of their own: nothing is capped. A task returns a spanning forest of its
links, not the links.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, lower_words_of, materialize, mix64, row_hash, spread
from .components import components

LIMIT, SHINGLE, SEED = 3, 3, 42
PIVOTS = 24
SLICE = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit i is set if over half of the shingles' XXH64 values have it; 0 for a text without words."""
    words = lower_words_of(text)
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return digest(b" ".join(words), seed)
    n = len(words) - shingle + 1
    votes, step = np.zeros(64, np.int64), 1 << 15
    for at in range(0, n, step):
        some = words[at : min(n, at + step) + shingle - 1]
        hashes = np.array([digest(b" ".join(s), seed) for s in zip(*(some[k:] for k in range(shingle)), strict=False)], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, row: Column | None = None) -> DataFrame:
    """doc_id, row and fp (the fingerprint's bits as a long) of every row; no shuffle."""

    def rows(batches):
        for pdf in batches:
            fps = np.array([fingerprint(t, shingle) for t in pdf["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "row": pdf["row"], "fp": fps})

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.lit(0).cast("long") if row is None else row).alias("row"), F.col(text_col).alias("text"))
    return named.mapInPandas(rows, "doc_id long, row long, fp long")


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints, spread by a fixed mixing function; as signed longs."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64).tolist()


def masks(total: int, limit: int = LIMIT) -> list[int]:
    """Choices of all blocks but `limit`, as signed bit masks. More blocks make keys longer, for more fingerprints."""
    blocks = limit + (2 if total < 1 << 26 else 3)
    ends = [64 * i // blocks for i in range(blocks + 1)]
    bits = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(ends)]
    chosen = [sum(c) for c in itertools.combinations(bits, blocks - limit)]
    return np.array(chosen, np.uint64).view(np.int64).tolist()


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least node that the links u-v reach."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def links(pdf: pd.DataFrame, limit: int = LIMIT) -> pd.DataFrame:
    """A spanning forest (u, v: fingerprints) of the links among rows of the same (mask, key, a, b)."""
    pdf = pdf.assign(first=[p[0] for p in pdf["table"]]).sort_values(["mask", "key", "a", "b", "first", "fp"], kind="stable")
    fp = pdf["fp"].to_numpy(np.int64).view(np.uint64)
    table = np.frombuffer(b"".join(pdf["table"]), np.uint8).reshape(len(pdf), -1).astype(np.int8)
    first = table[:, 0].astype(np.int64)
    change = np.zeros(len(pdf), bool)
    for c in ("mask", "key", "a", "b"):
        x = pdf[c].to_numpy()
        change[1:] |= x[1:] != x[:-1]
    group, part, across = np.cumsum(change), pdf["part"].to_numpy(), (pdf["a"] != pdf["b"]).to_numpy()
    at, us, vs, held = np.arange(len(pdf)), [], [], 0
    label = np.arange(len(pdf))
    step = 0
    while len(at):
        step += 1
        at = at[at + step < len(pdf)]
        to = at + step
        near = (group[at] == group[to]) & (first[to] - first[at] <= limit)
        at = at[near]
        to = at + step
        pair = ~across[at] | (part[at] != part[to])  # slices meet each other here, and themselves elsewhere
        i, j = at[pair], to[pair]
        for s in range(0, len(i), 1 << 16):
            a, b = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            close = np.abs(table[a] - table[b]).max(1) <= limit
            a, b = a[close], b[close]
            same = np.bitwise_count(fp[a] ^ fp[b]) <= limit
            us.append(a[same])
            vs.append(b[same])
            held += int(same.sum())
        if held > 1 << 20:
            label = forest(np.concatenate([*us, np.arange(len(pdf))]), np.concatenate([*vs, label]), len(pdf))
            us, vs, held = [], [], 0
    label = forest(np.concatenate([*us, np.arange(len(pdf))]), np.concatenate([*vs, label]), len(pdf))
    tied = label != np.arange(len(pdf))
    signed = fp.view(np.int64)
    return pd.DataFrame({"u": signed[tied], "v": signed[label[tied]]}).drop_duplicates()


def linked(fps: DataFrame, limit: int = LIMIT) -> DataFrame:
    """fp, least (its least doc_id) and root (the fingerprint that names its component) of each distinct fingerprint."""
    distances = F.concat(*(F.unhex(F.lpad(F.hex(F.bit_count(F.col("fp").bitwiseXOR(F.lit(p)))), 2, "0")) for p in pivots()))
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("table", distances))
    total = distinct.count()
    chosen = masks(total, limit)
    rows = distinct.select("fp", F.posexplode(F.array(*map(F.lit, chosen))).alias("mask", "bits"))
    rows = rows.select("fp", "mask", F.col("fp").bitwiseAND(F.col("bits")).alias("key"))
    met = materialize(rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1"))
    rows = rows.join(met, ["mask", "key"]).withColumn("slices", F.ceil(F.col("n") / SLICE).cast("int"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("slices")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    rows = rows.select("fp", "mask", "key", "part", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"))
    deals = max(spread(fps.sparkSession), total // 20_000)
    rows = rows.withColumn("deal", F.pmod(F.xxhash64("mask", "key", "a", "b"), F.lit(deals)))
    rows = rows.join(distinct.select("fp", "table"), "fp")
    found = rows.groupBy("deal").applyInPandas(lambda pdf: links(pdf, limit), "u long, v long")
    roots = components(found)
    return materialize(distinct.select("fp", "least").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of `docs`.

    component_id is the least doc_id that links reach. Null, empty and wordless texts have fingerprint 0, which links
    like any other. A null id takes part, but isn't a least id; where a group has no other, component_id is null.
    Repeated rows share a fingerprint.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle))
    named = linked(fps, limit)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, shingle: int = SHINGLE) -> DataFrame:
    """One row of `docs` of each group that links reach, with all its columns: that of the least id, null last, then of the
    least hash over all columns. Rows that are equal in everything are one row."""
    columns, row = docs.columns, row_hash(docs)
    fps = materialize(fingerprints(docs, id_col, text_col, shingle, row))
    named = fps.join(linked(fps, limit).select("fp", "root"), "fp")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    stay = materialize(named.groupBy("root").agg(first).select(F.col("first.doc_id").alias("id"), F.col("first.row").alias("row")))
    whole = docs.select(F.struct(*columns).alias("whole"), F.col(id_col).cast("long").alias("key"), row.alias("hash"))
    kept = whole.join(stay, F.col("key").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("row")), "left_semi")
    return kept.dropDuplicates(["key", "hash"]).select("whole.*")


def op8(spark, sf_dir):
    """Fingerprint and component of every row of `documents`; nulls, wordless texts and repeated rows as near_duplicates()
    says."""
    return near_duplicates(documents(spark, sf_dir, "doc_id", "text"))
