"""Sharding by a hierarchical weighted hash tree (op 4).

A row descends region, rack and shard. At each level every child makes a
weighted draw from a hash of (row key, child): an exponential variate with the
child's weight as its rate. The smallest draw wins, so a child is chosen with
probability proportional to its weight, and a change of one weight moves rows
only into or out of the subtree whose weight changed.

The base tree has ``regions * racks * shards_per_rack`` equal shards. Further
shards are added as new top-level branches (a region with one rack and one
shard of the usual weight). A new branch leaves all the other draws as they
were, so rows move only into the new shard and between no two old ones.

Everything is a projection (hash, logarithm, least draw), plus a two-level
count for the slots: rows are ranked inside (shard, block) and the small table
of block counts gives each block its offset, so no shard meets in one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldpulse.llm.common import shuffle_parts


@dataclass(frozen=True)
class Node:
    """A branch: its name enters the hash, its weight is that of its shards."""

    name: str
    children: tuple["Node", ...] = ()
    shard: int = -1
    leaf_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.leaf_weight


def hash_tree(n_shards: int, regions: int = 2, racks: int = 3, shards_per_rack: int = 4) -> Node:
    """Regions of racks of shards, numbered in order; shards beyond the base tree are branches of their own."""
    base = regions * racks * shards_per_rack
    if n_shards < base:
        raise ValueError(f"the base tree has {base} shards")
    tops, shard = [], 0
    for region in range(regions):
        own = []
        for rack in range(racks):
            leaves = tuple(Node(f"{region}/{rack}/{i}", shard=shard + i) for i in range(shards_per_rack))
            shard += shards_per_rack
            own.append(Node(f"{region}/{rack}", leaves))
        tops.append(Node(f"{region}", tuple(own)))
    for extra in range(n_shards - base):
        name = f"{regions + extra}"
        tops.append(Node(name, (Node(f"{name}/0", (Node(f"{name}/0/0", shard=shard + extra),)),)))
    return Node("", tuple(tops))


def _draw(key: Column, node: Node) -> Column:
    """Exponential variate of rate ``node.weight`` from a hash of the key and the node's name."""
    unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(node.name)), 11).cast("double") + 0.5) / math.ldexp(1, 53)
    return -F.log(unit) / F.lit(float(node.weight))


def _descend(key: Column, node: Node) -> Column:
    if not node.children:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return _descend(key, node.children[0])
    # the least draw; equal draws (a hash collision) go to the earlier child
    draws = [_draw(key, c) for c in node.children]
    least = F.least(*draws)
    out = _descend(key, node.children[-1])
    for child, draw in list(zip(node.children, draws))[-2::-1]:
        out = F.when(draw == least, _descend(key, child)).otherwise(out)
    return out


def shard_of(key: Column, n_shards: int, **shape: int) -> Column:
    """The shard of a key; a null key hashes like any other value."""
    return _descend(key, hash_tree(n_shards, **shape))


def assign(docs: DataFrame, n_shards: int = 24, blocks: int | None = None, **shape: int) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    Size: UTF-8 bytes of the text (null: none) plus 8. ``law`` is ``key``: only
    doc_id and the shard count decide. Null doc_ids go to one common shard, rows
    with equal doc_id to the same shard with different slots. An empty table
    gives no rows; other columns of ``docs`` are ignored.
    """
    blocks = blocks or 4 * shuffle_parts(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumns({
        "shard": shard_of(F.col("doc_id"), n_shards, **shape),
        "grown_shard": shard_of(F.col("doc_id"), n_shards + 1, **shape),
        # repeated doc_ids still spread: their size and checksum enter the block
        "block": F.pmod(F.xxhash64("doc_id", "size", "text_crc32", F.lit("block")), F.lit(blocks)).cast("int"),
    })
    inside = Window.partitionBy("shard", "block").orderBy("doc_id", "size", "text_crc32")
    counts = rows.groupBy("shard", "block").count()
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # at most n_shards * blocks rows, both parameters
    offsets = counts.select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    return (rows.withColumn("rank", F.row_number().over(inside))
            .join(offsets, ["shard", "block"])
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("offset") + F.col("rank") - 1).alias("slot"), "grown_shard"))
