"""Mixing sources to target weights over a tree of domain, language and source.

A token budget flows down the tree. At every node it is shared by weight; a
child gets at most what its subtree holds (its tokens times the epochs allowed),
and what it cannot use goes to its siblings by weight, because a node's share is
cut only by its whole subtree's capacity. Only what all siblings cannot use is
left to the ancestors' other children. A leaf takes whole epochs, and of the
next one a prefix: its documents in the order of a hash seeded by the epoch, as
far as their tokens fit the rest of the budget.

Shares and prefixes are found with windows over the tree's nodes and over hash
ranges of a leaf. Only the range that holds the cut is ordered row by row, so no
task holds a leaf.

Defined cases: null names are a branch of their own, ``unknown``; null text has
no tokens; documents without tokens come along wherever they are in the prefix;
rows that repeat a doc_id in a leaf stand and fall together; a null doc_id is
one such id; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written
from .tables import text_of

UNKNOWN = "unknown"
RANGE_BITS = 12
WORD = r"[^\x20\x09-\x0D]+"
Weights = dict[tuple[str, ...], float]


def token_count(docs: DataFrame) -> Column:
    return tokens_in(text_of(docs))


def tokens_in(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def _weight(path: list[str], weights: Weights) -> Column:
    """The given weight of a node, 1 where none is given."""
    own = {k: v for k, v in weights.items() if len(k) == len(path)}
    if not own:
        return F.lit(1.0)
    table = F.create_map(*[x for k, v in own.items() for x in (F.array(*[F.lit(p) for p in k]), F.lit(float(v)))])
    return F.coalesce(table[F.array(*path)], F.lit(1.0))


def share_out(children: DataFrame, parent: list[str], path: list[str]) -> DataFrame:
    """Adds ``alloc``: the share of each child (weight, capacity) in its parent's ``budget``.

    Children are filled in the order of capacity by weight. The first that is
    not filled sets the level for all after it.
    """
    group = [F.lit(0)] + [F.col(c) for c in parent]
    order = W.partitionBy(*group).orderBy(F.col("capacity") / F.col("weight"), *path)
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    level = (F.col("budget") - before) / rest
    open_level = F.when(F.col("capacity") > F.col("weight") * F.col("_level"), F.col("_level"))
    return (children.withColumn("_level", level)
            .withColumn("_level", F.max(open_level).over(W.partitionBy(*group)))
            .withColumn("alloc", F.when(F.col("_level").isNull(), F.col("capacity"))
                        .otherwise(F.least("capacity", F.col("weight") * F.greatest(F.col("_level"), F.lit(0.0)))))
            .drop("_level"))


def budgets(leaves: DataFrame, levels: list[str], weights: Weights, budget: Column, epochs: int) -> DataFrame:
    """levels, tokens and budget of every leaf; ``leaves`` has levels and tokens."""
    at = (leaves.agg(budget.cast("double").alias("budget")))
    for depth in range(1, len(levels) + 1):
        path = levels[:depth]
        nodes = (leaves.groupBy(*path).agg((F.sum("tokens") * epochs).cast("double").alias("capacity"))
                 .withColumn("weight", _weight(path, weights)).where("weight > 0"))
        nodes = nodes.join(at, path[:-1]) if depth > 1 else nodes.withColumn("budget", at.scalar())
        at = share_out(nodes, path[:-1], path).select(*path, F.col("alloc").alias("budget"))
    return leaves.join(at, levels, "left").withColumn("budget", F.floor(F.coalesce("budget", F.lit(0.0))))


def _named(docs: DataFrame, levels: dict[str, Column]) -> list[Column]:
    return [F.coalesce(c.cast("string"), F.lit(UNKNOWN)).alias(name) for name, c in levels.items()]


def _order(seed: int, epoch: Column) -> Column:
    return F.xxhash64(F.lit(seed), epoch.cast("long"), F.col("doc_id").cast("long"))


def cuts(docs: DataFrame, levels: dict[str, Column], weights: Weights, share: float, epochs: int,
         seed: int) -> DataFrame:
    """For every leaf its tokens, budget, number of whole epochs and, in the next epoch, the last hash taken.

    ``share`` is the budget as a share of all tokens.
    """
    names = list(levels)
    rows = written(docs.select("doc_id", *_named(docs, levels), token_count(docs).alias("tokens")))
    leaves = rows.groupBy(*names).agg(F.sum("tokens").alias("tokens"))
    budget = F.coalesce(F.floor(F.sum("tokens") * F.lit(share)), F.lit(0))
    given = (budgets(leaves, names, weights, budget, epochs)
             .withColumn("whole", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens")))
                         .otherwise(F.lit(1)).cast("long"))
             .withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens")))
    given = written(given)
    ordered = (rows.join(given.select(*names, "whole", "rest"), names)
               .withColumn("hash", _order(seed, F.col("whole")))
               .withColumn("range", F.shiftright("hash", 64 - RANGE_BITS)))
    ranges = ordered.groupBy(*names, "range", "rest").agg(F.sum("tokens").alias("n"))
    running = W.partitionBy(*names).orderBy("range")
    ends = ranges.withColumn("end", F.sum("n").over(running))
    # the last hash of the ranges that fit, and the range that holds the cut
    full = (ends.where("end <= rest").groupBy(*names).agg(F.max("range").alias("last"))
            .select(*names, (F.shiftleft(F.col("last") + 1, 64 - RANGE_BITS) - 1).alias("full_cut")))
    broken = (ends.where("end > rest").groupBy(*names)
              .agg(F.min(F.struct("range", (F.col("end") - F.col("n")).alias("start"))).alias("b"))
              .select(*names, F.col("b.range").alias("range"), F.col("b.start").alias("start")))
    units = (ordered.join(broken, [*names, "range"])
             .groupBy(*names, "hash", "start", "rest").agg(F.sum("tokens").alias("n")))
    inside = W.partitionBy(*names).orderBy("hash")
    part = (units.withColumn("end", F.col("start") + F.sum("n").over(inside)).where("end <= rest")
            .groupBy(*names).agg(F.max("hash").alias("part_cut")))
    return written(given.join(full, names, "left").join(part, names, "left")
                   .withColumn("cut", F.coalesce("part_cut", "full_cut")).drop("full_cut", "part_cut", "rest"))


def select(docs: DataFrame, levels: dict[str, Column], weights: Weights, share: float, epochs: int,
           seed: int) -> DataFrame:
    """The chosen documents, one row for each epoch (from 0) that takes them: doc, leaf, budget, epoch.

    ``doc`` holds all columns of the document and ``leaf`` its levels, so no name can clash.
    The texts are not shuffled unless the table of leaves is too large to send along.
    """
    names = list(levels)
    found = cuts(docs, levels, weights, share, epochs, seed)
    found = found.select(F.struct(*names).alias("leaf"), "budget", "whole", "cut")
    marked = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["doc_id"],
                         F.struct(*_named(docs, levels)).alias("leaf"))
    taken = F.col("whole") + F.when(_order(seed, F.col("whole")) <= F.col("cut"), 1).otherwise(0)
    return (marked.join(found, "leaf").withColumn("taken", taken.cast("int")).where("taken > 0")
            .select("doc", "leaf", "budget", F.explode(F.sequence(F.lit(0), F.col("taken") - 1)).alias("epoch")))
