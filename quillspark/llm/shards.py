"""Sharding by a hierarchical weighted hash tree: region, rack, shard. DataFrame functions only.

At every level each child draws -ln(u) / weight with u hashed from the document
id and the child's name, and the least draw wins, so a child gets its share of
the weight. A draw depends on that child alone: when a weight grows, documents
move only into the subtree that holds it. A new shard enters as a region of its
own, so the documents that move all go to that shard, and no other pair of
shards exchanges any.

Defined cases: documents with a null doc_id are one key, and share a shard; a
null text counts as empty (size 16); repeated rows go to the same shard, in
slots of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import dense_rank_slots, text_of

ROOT = "root"
ROW_BYTES = 16


@dataclass(frozen=True)
class Tree:
    """Children of each inner node as (name, weight); the names of leaves are shard numbers."""

    regions: tuple[tuple[str, float], ...]
    racks: dict[str, tuple[tuple[str, float], ...]]
    shards: dict[str, tuple[tuple[str, float], ...]]

    @staticmethod
    def even(regions: int, racks: int, shards: int) -> "Tree":
        """Equal shards, numbered through."""
        return Tree(tuple((f"r{i}", float(racks * shards)) for i in range(regions)),
                    {f"r{i}": tuple((f"r{i}.{j}", float(shards)) for j in range(racks)) for i in range(regions)},
                    {f"r{i}.{j}": tuple((str((i * racks + j) * shards + k), 1.0) for k in range(shards))
                     for i in range(regions) for j in range(racks)})

    def grown(self, shard: int, weight: float = 1.0) -> "Tree":
        """With one more shard, in a region and rack of its own."""
        region, rack = f"r+{shard}", f"r+{shard}.0"
        return Tree((*self.regions, (region, weight)), {**self.racks, region: ((rack, weight),)},
                    {**self.shards, rack: ((str(shard), weight),)})


def _winner(key: Column, children: Column) -> Column:
    """The name of the child with the least draw."""
    def draw(child: Column) -> Column:
        unit = (F.shiftrightunsigned(F.xxhash64(key, child["name"]), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        return F.struct((-F.log(unit) / child["weight"]).alias("draw"), child["name"].alias("name"))

    return F.array_min(F.transform(children, draw))["name"]


def _children(nodes) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight")) for n, w in nodes])


def _level(of: dict) -> Column:
    return F.create_map(*[x for name, nodes in of.items() for x in (F.lit(name), _children(nodes))])


def shard_of(docs: DataFrame, key: str, tree: Tree, name: str) -> DataFrame:
    """``docs`` with the shard of ``key`` in ``tree``: three descents, no shuffle."""
    return (docs.withColumn("_region", _winner(F.col(key), _children(tree.regions)))
            .withColumn("_rack", _winner(F.col(key), _level(tree.racks)[F.col("_region")]))
            .withColumn(name, _winner(F.col(key), _level(tree.shards)[F.col("_rack")]).cast("int"))
            .drop("_region", "_rack"))


def place(docs: DataFrame, tree: Tree, next_shard: int) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and the shard in the grown tree, of every document."""
    text = text_of(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
                       F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), F.lit("key").alias("law"))
    placed = shard_of(shard_of(rows, "doc_id", tree, "shard"), "doc_id", tree.grown(next_shard), "grown_shard")
    return (dense_rank_slots(placed, "shard", "doc_id", "slot")
            .select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"))
