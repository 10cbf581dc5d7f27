"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard levels. At each node every child draws -ln(u) / weight, u being a hash of the
row's key and the child's path, and the smallest draw wins; a subtree's weight is the sum of its shards'. If weights
change, a row moves only where a child on the changed path wins or loses it, so subtrees without a change of weight
keep their rows among themselves. A tree that grows by a new region takes rows into the new region alone.

Defined results: the key is doc_id as text, so equal doc_ids share a shard whatever their texts; a null doc_id counts as
the text "null"; a null text has size 8 and the checksum 0; an empty table gives an empty one; other columns aren't read.
Slots within a shard follow a hash bucket, then doc_id, checksum and size; repeated rows take neighbouring slots.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm import common

#: Slots are counted per shard and bucket, so the table of offsets has shards x BUCKETS rows at most, whatever the input.
BUCKETS = 1024
_FULL = 1 << 52


@dataclass(frozen=True)
class Node:
    """A region, rack or shard; weight counts for leaves only, shard names the leaf's number."""

    name: str
    children: tuple["Node", ...] = ()
    weight: float = 1.0
    shard: int = -1

    @property
    def total(self) -> float:
        return sum(c.total for c in self.children) if self.children else self.weight


def tree(shards: int, racks: int = 2, per_rack: int = 4) -> Node:
    """shards leaves in regions of racks x per_rack; the last region takes what is left."""
    regions, leaf = [], 0
    while leaf < shards:
        own = []
        for k in range(racks):
            size = min(per_rack, shards - leaf)
            if size > 0:
                own.append(Node(f"rack{k}", tuple(Node(f"shard{leaf + i}", shard=leaf + i) for i in range(size))))
                leaf += size
        regions.append(Node(f"region{len(regions)}", tuple(own)))
    return Node("root", tuple(regions))


def _draw(key: Column, path: str, weight: float) -> Column:
    digits = F.conv(F.substring(F.md5(F.concat(key, F.lit(path))), 1, 13), 16, 10).cast("double")
    return -F.log((digits + 0.5) / F.lit(float(_FULL))) / F.lit(float(weight))


def place(key: Column, node: Node, path: str = "") -> Column:
    """The shard that the tree gives to a key (a string column)."""
    if not node.children:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return place(key, node.children[0], f"{path}/{node.children[0].name}")
    draws = [F.struct(_draw(key, f"{path}/{c.name}", c.total).alias("draw"), F.lit(i).alias("child")) for i, c in enumerate(node.children) if c.total > 0]
    won = F.array_min(F.array(*draws))["child"]
    out = None
    if not any(c.children for c in node.children):
        return F.element_at(F.array(*[F.lit(c.shard) for c in node.children]), won + 1)
    for i, c in enumerate(node.children):
        below = place(key, c, f"{path}/{c.name}")
        out = F.when(won == i, below) if out is None else out.when(won == i, below)
    return out


def with_slots(placed: DataFrame, key: Column, order: list[str], buckets: int = BUCKETS) -> DataFrame:
    """placed with slot: gapless from 0 in each shard. No task sorts a whole shard: rows are numbered per hash bucket, and buckets get offsets from their counts."""
    table = placed.withColumn("bucket", (F.conv(F.substring(F.md5(F.concat(key, F.lit("/slot"))), 1, 8), 16, 10).cast("long") % buckets).cast("int"))
    counts = table.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy(*order)) - 1
    return table.withColumn("own", own).join(F.broadcast(offsets), ["shard", "bucket"]).withColumn("slot", F.col("own") + F.col("offset")).drop("own", "offset", "bucket")


def assign(docs: DataFrame, now: Node, grown: Node) -> DataFrame:
    """Per document: doc_id, size, text_crc32, shard, slot, and grown_shard, its place in the grown tree."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    sized = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    placed = common.stored(sized.withColumn("shard", place(key, now)).withColumn("grown_shard", place(key, grown)), "placed")
    return with_slots(placed, key, ["doc_id", "text_crc32", "size"])


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = assign(common.read(spark, sf_dir, "documents"), tree(24), tree(25))
    return table.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
