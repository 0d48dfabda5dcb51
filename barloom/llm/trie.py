"""Prefix trie of conversations, with sums over subtrees by heavy-path decomposition.

A node is a distinct sequence of first turns. A turn is known by a digest and its place; the digests of a prefix, mixed with
their places and joined by exclusive or, name the prefix, so names come from running windows and a child's name gives its
parent's. The largest child of a node (most conversations, then least id) goes on its path; every other child begins a path of
its own, and as it holds at most half of its parent's conversations, a way down meets few of them. Sums over subtrees are then
suffix sums along paths, begun with the paths that lie deepest: what a path's first node sums up to is added to its parent
before the parent's path is summed, in as many rounds as a way down meets beginnings of paths.

Places and paths are cut into segments, within which windows run; what segments hand on is added afterwards. So neither a
conversation nor a path has to fit into one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SEGMENT = 4096
NODE = ["conv_id", "depth"]
ENDS = "conv_id long, depth long, ends_sha256 string"
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, said, bytes of every row with an id: a digest of role and text (null: empty), and the text's UTF-8 bytes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    said = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    return conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), said.alias("said"), F.octet_length(text).cast("long").alias("bytes")
    )


def placed(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), said, bytes: by turn, null first, then by digest.

    Slices are ranges of that order, so a conversation may lie in several. Each numbers its own, and a slice has at most one
    conversation that began in an earlier one: that many rows are broadcast.
    """
    order = [F.col("turn").asc_nulls_first(), F.col("said")]
    cut = turns.withColumn("row", F.monotonically_increasing_id()).repartitionByRange("conv_id", *order, "row")
    cut = materialize(cut.withColumn("slice", F.spark_partition_id()))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    begun = cut.groupBy("conv_id", "slice").agg(F.count("*").alias("n")).withColumn("before", before).where("before > 0").drop("n")
    here = F.row_number().over(Window.partitionBy("conv_id", "slice").orderBy(*order))
    rows = cut.withColumn("here", here).join(F.broadcast(begun), ["conv_id", "slice"], "left")
    return rows.select("conv_id", (F.col("here") + F.coalesce("before", F.lit(0))).cast("long").alias("place"), "said", "bytes")


def lengths(sequences: DataFrame) -> DataFrame:
    return sequences.groupBy("conv_id").agg(F.max("place").alias("length"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sequences and their lengths after every conversation c takes over the first crc32(c) % 9 turns of c - c % 5."""
    turns = materialize(placed(turns))
    convs = lengths(turns).withColumn("head", F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).withColumn("base", F.col("conv_id") - F.col("conv_id") % 5)
    bases = convs.select(F.col("conv_id").alias("base"), F.col("length").alias("there"))
    lead = F.least("head", F.coalesce("there", F.lit(0)))
    convs = convs.join(bases, "base", "left").withColumn("lead", lead)
    convs = materialize(convs.select("conv_id", "base", "head", "lead", (F.col("lead") + F.greatest(F.col("length") - F.col("head"), F.lit(0))).alias("length")))
    own = turns.join(convs.select("conv_id", "head", "lead"), "conv_id").where("place > head").select("conv_id", (F.col("place") - F.col("head") + F.col("lead")).alias("place"), "said", "bytes")
    first = turns.where("place <= 8").withColumnRenamed("conv_id", "base")
    taken = first.join(convs.select("conv_id", "base", "lead"), "base").where("place <= lead").select("conv_id", "place", "said", "bytes")
    return own.unionByName(taken), convs.select("conv_id", "length")


def named(sequences: DataFrame, segment: int) -> DataFrame:
    """conv_id, place, bytes, a and b (the prefix's name), up_a and up_b (its parent's; zeros name the root)."""
    mixed = sequences.select("conv_id", "place", "bytes", *(F.xxhash64(F.lit(k), "place", "said").alias(c) for k, c in enumerate("xy")), F.floor(F.col("place") / segment).alias("segment"))
    along = Window.partitionBy("conv_id", "segment").orderBy("place")
    local = materialize(mixed.withColumns({"a": F.bit_xor("x").over(along), "b": F.bit_xor("y").over(along)}))
    before = Window.partitionBy("conv_id").orderBy("segment")
    handed = local.where(F.col("place") % segment == segment - 1).select(
        "conv_id", (F.col("segment") + 1).alias("segment"), F.bit_xor("a").over(before).alias("before_a"), F.bit_xor("b").over(before).alias("before_b")
    )
    rows = local.join(handed, ["conv_id", "segment"], "left")
    whole = {c: F.col(c).bitwiseXOR(F.coalesce(f"before_{c}", F.lit(0))) for c in "ab"}
    up = {f"up_{c}": F.col(c).bitwiseXOR(F.col(x)) for c, x in zip("ab", "xy", strict=True)}
    return rows.withColumns(whole).withColumns(up).select("conv_id", "place", "bytes", "a", "b", "up_a", "up_b")


def nodes_of(rows: DataFrame) -> DataFrame:
    """Every node but the root: depth, name, least conversation, their number, children, and whether it begins a path."""
    nodes = rows.groupBy(F.col("place").alias("depth"), "a", "b").agg(
        F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.max("up_a").alias("up_a"), F.max("up_b").alias("up_b")
    )
    nodes = materialize(nodes)
    largest = F.min(F.struct(-F.col("n_convs"), F.col("node").alias("node")))
    kids = materialize(nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("n_children"), largest.alias("largest")))
    heavy = kids.select((F.col("depth") + 1).alias("depth"), F.col("largest.node").alias("node"), F.lit(True).alias("heavy"))
    named_ = nodes.drop("up_a", "up_b").join(kids.drop("largest"), ["depth", "a", "b"], "left").join(heavy, ["depth", "node"], "left")
    return named_.withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("light", F.col("heavy").isNull()).drop("heavy")


def paths(rows: DataFrame, nodes: DataFrame, root: int, segment: int) -> tuple[DataFrame, DataFrame]:
    """The nodes with parent, path (id and depth of its first node) and level (beginnings of paths above it, or at it), each by
    the way down to its least conversation; and the node at each conversation's every place."""
    there = rows.select("conv_id", F.col("place").alias("depth"), "a", "b").join(nodes, ["depth", "a", "b"]).drop("a", "b")
    there = there.withColumn("segment", F.floor(F.col("depth") / segment))
    along = Window.partitionBy("conv_id", "segment").orderBy("depth")
    begins = F.when(F.col("light"), F.struct("depth", "node"))
    local = materialize(there.withColumns({
        "level": F.count(F.when(F.col("light"), 1)).over(along), "path": F.max(begins).over(along), "parent": F.lag("node").over(along), "last": F.col("node"),
    }))
    before = Window.partitionBy("conv_id").orderBy("segment")
    handed = local.where(F.col("depth") % segment == segment - 1).select(
        "conv_id", (F.col("segment") + 1).alias("segment"), F.sum("level").over(before).alias("levels"), F.max("path").over(before).alias("above"), F.col("last").alias("previous")
    )
    at_root = F.struct(F.lit(0).cast("long").alias("depth"), F.lit(root).cast("long").alias("node"))
    rows = local.where("conv_id = node").join(handed, ["conv_id", "segment"], "left")
    path = F.coalesce("path", "above", at_root)
    found = rows.select(
        "conv_id", "depth", "n_convs", "bytes", "n_children", path["node"].alias("path"), path["depth"].alias("begin"),
        (F.col("level") + F.coalesce("levels", F.lit(0))).alias("level"), F.coalesce("parent", "previous", F.lit(root)).cast("long").alias("parent_conv_id"),
    )
    return found, local.select("conv_id", "depth", "node")


def suffix_sums(nodes: DataFrame, segment: int) -> DataFrame:
    """n_leaves and saved_tokens of each node become those of its path from there on."""
    names = ["n_leaves", "saved_tokens"]
    cut = nodes.withColumn("segment", F.floor((F.col("depth") - F.col("begin")) / segment))
    along = Window.partitionBy("path", "begin", "segment").orderBy(F.desc("depth"))
    local = materialize(cut.withColumns({c: F.sum(c).over(along) for c in names}))
    after = Window.partitionBy("path", "begin").orderBy(F.desc("segment"))
    handed = local.where((F.col("segment") > 0) & ((F.col("depth") - F.col("begin")) % segment == 0)).select("path", "begin", (F.col("segment") - 1).alias("segment"), *(F.sum(c).over(after).alias("more_" + c) for c in names))
    rows = local.join(handed, ["path", "begin", "segment"], "left")
    return rows.withColumns({c: F.col(c) + F.coalesce("more_" + c, F.lit(0)) for c in names}).select(*nodes.columns)


def summed(nodes: DataFrame, levels: int, segment: int) -> DataFrame:
    """The sums over subtrees, from the last level up. Each round reads its own level, and what the one below hands on."""
    added, done = None, None
    for level in range(levels, -1, -1):
        here = nodes.where(F.col("level") == level).withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes")})
        if added is not None:
            here = here.join(added, NODE, "left").withColumns({c: F.col(c) + F.coalesce("add_" + c, F.lit(0)) for c in ("n_leaves", "saved_tokens")}).drop("add_n_leaves", "add_saved_tokens")
        made = materialize(suffix_sums(here, segment))
        added = made.where("depth = begin and depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
            F.sum("n_leaves").alias("add_n_leaves"), F.sum("saved_tokens").alias("add_saved_tokens"))
        done = made if done is None else done.unionByName(made)
    return done


def ends(at: DataFrame, run: int = 4096) -> DataFrame:
    """ends_sha256 of the nodes where conversations end, from (node, depth, conv_id).

    Ids are joined in runs of at most `run` of them first, so that what one task reads of a node where very many end is short,
    and then streamed through the hash: memory stays bounded by a batch.
    """
    runs = at.groupBy(F.col("node").alias("conv_id"), "depth", F.floor(F.col("conv_id") / run).alias("run")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state = None, None
        for pdf in batches:
            out = []
            for conv_id, depth, ids in zip(pdf["conv_id"], pdf["depth"], pdf["ids"], strict=True):
                if (conv_id, depth) != node:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = (conv_id, depth), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=["conv_id", "depth", "ends_sha256"])
        if node is not None:
            yield pd.DataFrame([(*node, state.hexdigest())], columns=["conv_id", "depth", "ends_sha256"])

    return runs.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "run").drop("run").mapInPandas(hashed, ENDS)


def trie_of(sequences: DataFrame, convs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The nodes of the trie of `sequences` (conv_id, place, said, bytes); `convs` has every conv_id and its length, 0 too."""
    root, n_convs = convs.agg(F.min("conv_id"), F.count("*")).first()
    rows = materialize(named(sequences, segment))
    known = materialize(nodes_of(rows))
    nodes, at = paths(rows, known, root or 0, segment)
    top = convs.agg(F.count("*").alias("n_convs")).where("n_convs > 0").select(
        F.lit(root).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("bytes"),
        F.lit(known.where("depth = 1").count()).cast("long").alias("n_children"),
        F.lit(root).cast("long").alias("path"), F.lit(0).cast("long").alias("begin"), F.lit(0).cast("long").alias("level"), F.lit(None).cast("long").alias("parent_conv_id"),
    )
    nodes = materialize(nodes.unionByName(top), "level") if n_convs else nodes.limit(0)
    levels = nodes.agg(F.max("level")).first()[0] or 0
    sums = summed(nodes, levels, segment)
    lasts = at.join(convs, "conv_id").where("depth = length").select("node", "depth", "conv_id").unionByName(
        convs.where("length = 0").select(F.lit(root).cast("long").alias("node"), F.lit(0).cast("long").alias("depth"), "conv_id"))
    return sums.join(ends(lasts), NODE, "left").select(
        *NODE, "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256")
    )


def conversation_trie(conversations: DataFrame, segment: int = SEGMENT, **columns: str) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for each distinct sequence of
    first turns: its least conversation and their number, children, childless nodes in its subtree, UTF-8 bytes that need not
    be read again where conversations share turns, and a hash of the ids that end there.

    Null roles and texts are empty, null turns come first, turns of equal number are ordered by their digest and count each, as
    do repeated rows. Rows without an id belong to no conversation. An empty table has no nodes. Texts of any length are hashed
    whole; other columns are not read. `columns` names id_col, turn_col, role_col and text_col.
    """
    turns = materialize(placed(turns_of(conversations, **columns)))
    return trie_of(turns, materialize(lengths(turns)), segment)


def node_turns(conversations: DataFrame, nodes: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The last turn of each node of conversation_trie() as conv_id, depth, role, text: what a writer of shared prefixes stores
    once. The root has none."""
    at = materialize(placed(turns_of(conversations, id_col, turn_col, role_col, text_col))).join(nodes.where("depth > 0").select("conv_id", F.col("depth").alias("place")), ["conv_id", "place"])
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    said: Column = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    texts = conversations.select(F.col(id_col).cast("long").alias("conv_id"), said.alias("said"), role.alias("role"), text.alias("text")).dropDuplicates(["conv_id", "said"])
    return at.join(texts, ["conv_id", "said"]).select("conv_id", F.col("place").alias("depth"), "role", "text")


def op11(spark, sf_dir):
    """The trie of all rebuilt conversations; nulls, ties and empty tables as conversation_trie() says."""
    turns = turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    sequences, convs = rebuilt(turns)
    return trie_of(sequences, convs)
