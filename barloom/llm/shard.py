"""Sharding: a hierarchical weighted hash tree (region, rack, shard), descended by weighted hash draws.

At each level every child draws ln(u) / weight with u in (0, 1) hashed from the row's key and the child's name, and the
largest draw wins: children get rows in proportion to weight. A child's draws depend on nothing but its own name and
weight, so a change moves rows only into or out of subtrees whose weights changed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents


@dataclass(frozen=True)
class Node:
    """A leaf has a shard number; an inner node has children. Its weight is the sum of its leaves' weights."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    leaf_weight: float = 1.0

    @property
    def weight(self) -> float:
        return self.leaf_weight if self.shard is not None else sum(c.weight for c in self.children)


def tree(shards: int, per_rack: int = 4, racks: int = 2, base: int = 16) -> Node:
    """Equal shards in racks and regions. Shards from `base` on each get a region of their own: a subtree whose weight
    grows may hand its new rows to old shards, and one that holds a single shard can't."""
    rows = []
    for region in range(0, min(shards, base), per_rack * racks):
        held = []
        for rack in range(region, min(shards, base, region + per_rack * racks), per_rack):
            leaves = tuple(Node(f"s{i}", shard=i) for i in range(rack, min(shards, base, rack + per_rack)))
            held.append(Node(f"k{rack // per_rack}", leaves))
        rows.append(Node(f"r{region // (per_rack * racks)}", tuple(held)))
    rows += [Node(f"x{i}", (Node(f"xk{i}", (Node(f"s{i}", shard=i),)),)) for i in range(base, shards)]
    return Node("root", tuple(rows))


def levels(root: Node) -> list[list[list[Node]]]:
    """For each level, the children of every node of the level above, in order."""
    out, above = [], [root]
    while any(n.children for n in above):
        out.append([list(n.children) for n in above])
        above = [c for n in above for c in n.children]
    return out


def draw(key: Column, name: Column, weight: Column) -> Column:
    """ln(u) / weight, u from the first 52 bits of md5 of the node's name and the key."""
    digits = F.substring(F.md5(F.concat(name, F.lit(":"), key).cast("binary")), 1, 13)
    return F.ln((F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)) / weight


def place(key: Column, root: Node) -> Column:
    """The shard of a row. Each level looks up the children of the node found above, as literals, and draws for them
    alone; equal draws go to the later child."""
    found, deepest = F.lit(0), []
    for groups in levels(root):
        table, at, deepest = [], 0, [c for g in groups for c in g]
        for group in groups:
            table.append(F.array(*(F.struct(F.lit(c.name).alias("name"), F.lit(float(c.weight)).alias("weight"), F.lit(at + i).alias("at")) for i, c in enumerate(group))))
            at += len(group)
        children = F.element_at(F.array(*table), found + 1)
        found = F.array_max(F.transform(children, lambda c: F.struct(draw(key, c["name"], c["weight"]).alias("draw"), c["at"].alias("at"))))["at"]
    return F.element_at(F.array(*(F.lit(n.shard) for n in deepest)), found + 1)


def assign_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", parts: int = 256) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Law `key`: doc_id and the number of shards decide; one more shard only takes rows. Null ids share the shard of the
    empty key; null texts have no bytes (size 1, crc32 0). Repeated rows share a shard and get slots of their own.
    Slots are numbered within (shard, part) with `parts` parts of a shard, hashed from id and text, and then moved by the
    counts of the parts before: no task sorts a whole shard, nor all rows without an id.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    size, crc = F.octet_length(text).cast("long") + 1, F.crc32(text.cast("binary"))
    slot = F.md5(F.concat_ws(":", F.lit("slot"), key, size.cast("string"), crc.cast("string")).cast("binary"))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), size.alias("size"), crc.alias("text_crc32"),
        F.lit("key").alias("law"),
        place(key, tree(shards)).cast("int").alias("shard"),
        place(key, tree(shards + 1)).cast("int").alias("grown_shard"),
        F.pmod(F.conv(F.substring(slot, 1, 8), 16, 10).cast("long"), F.lit(parts)).cast("int").alias("part"),
    )
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32")
    numbered = rows.withColumn("at", F.row_number().over(within) - 1)
    # at most shards x parts rows: a proven bound
    joined = numbered.join(F.broadcast(starts), ["shard", "part"])
    return joined.select("doc_id", "size", "text_crc32", "law", "shard", (F.col("start") + F.col("at")).cast("long").alias("slot"), "grown_shard")


def op7(spark, sf_dir):
    """Shards 0 to 15 for all rows of `documents`; nulls, repeated rows and empty texts as assign_shards() says."""
    return assign_shards(documents(spark, sf_dir, "doc_id", "text"))
