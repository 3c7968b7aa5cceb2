"""Merkle manifest of a dataset, with nested-interval labels on its nodes.

Leaves of a group are ranked; a node carries the interval of leaf ranks that it
covers. Every ``arity`` consecutive nodes of a level become a parent until one
node, the group's subroot, remains; the subroots are the leaves of one more tree.

Ancestors are attached from the root down. At each level a node meets its parent
by an equality join on the level's bucket of leaf ranks, and must lie in the
parent's interval. The parent's other children, before and after the node by
their intervals, are its siblings. A level has an arity-th of the rows of the
level below, so all joins together move little more than the leaves once, and no
key has more than ``arity`` rows, however large a group is.

Ranks come from ranges of the sort order: rows are numbered inside a range and
moved on by the sizes of the ranges before it. No task holds a group.

Defined cases: a null field is ``-``; the null group comes first, null keys come
first in their group and are never tampered with; rows of one key are ordered by
their leaf (of wholly equal rows, the order makes no difference); long texts are
hashed in the row; other columns are not looked at; an empty table gives an
empty result.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import written

ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ROW_BITS = 33  # monotonically_increasing_id: the partition stands above them


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the strings one after the other."""
    return F.sha2(F.encode(F.concat(*parts), "utf-8"), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def lowered(docs: DataFrame) -> dict[str, Column]:
    """The tampering of the query: A-Z of the text in lower case."""
    return {"text": F.translate(docs["text"].cast("string"), string.ascii_uppercase, string.ascii_lowercase)}


def third_of_ids(docs: DataFrame) -> Column:
    return F.crc32(F.encode(docs["doc_id"].cast("string"), "utf-8")) % 3 == 0


def leaves(docs: DataFrame, group: str, key: str, fields: tuple[str, ...],
           tampered: Column, change: dict[str, Column]) -> DataFrame:
    """key, grp (sorts like the group, null first), hash and the hash after tampering."""
    own = digest(*[encoded(docs[c]) for c in fields])
    other = digest(*[encoded(change.get(c, docs[c])) for c in fields])
    return docs.select(
        docs[key].cast("long").alias("key"),
        F.coalesce(F.concat(F.lit("="), docs[group].cast("string")), F.lit("")).alias("grp"),
        own.alias("hash"), F.when(tampered, other).alias("altered"))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with their rank in ``grp`` (lo, and hi = lo + 1) and the group's size n."""
    placed = written(
        rows.withColumn("tie", F.monotonically_increasing_id())
        .repartitionByRange("grp", *order, "tie").sortWithinPartitions("grp", *order, "tie").drop("tie")
        .withColumn("at", F.monotonically_increasing_id())
        .withColumn("range", F.shiftright("at", ROW_BITS)))
    whole = W.partitionBy("grp")
    before = whole.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = (placed.groupBy("grp", "range").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
              .select("grp", "range", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"),
                      F.sum("rows").over(whole).alias("n")))
    return (placed.join(ranges, ["grp", "range"])
            .withColumn("lo", F.col("base") + F.col("at") - F.col("first"))
            .withColumn("hi", F.col("lo") + 1)
            .drop("at", "range", "first", "base"))


def _bucket(level: int, arity: int) -> Column:
    """The parent's number among its level's nodes, for a node of ``level``."""
    return F.expr(f"lo div {arity ** (level + 1)}").alias("bucket")


def _parents(nodes: DataFrame, level: int, arity: int) -> DataFrame:
    """The level above: intervals, hashes and the (at most ``arity``) children of each node."""
    return (nodes.where(F.col("n") > arity ** level)
            .groupBy("grp", _bucket(level, arity))
            .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("n").alias("n"),
                 F.sort_array(F.collect_list(F.struct("lo", "hi", "hash"))).alias("children"))
            .withColumn("hash", digest(F.array_join("children.hash", ""))))


def levels(leaf_nodes: DataFrame, arity: int = ARITY) -> list[DataFrame]:
    """All nodes level by level, from the leaves (grp, lo, hi, n, hash) up; each level is written."""
    found = [written(leaf_nodes)]
    most = found[0].agg(F.max("n").alias("n")).first()["n"] or 0
    while arity ** (len(found) - 1) < most:
        found.append(written(_parents(found[-1], len(found) - 1, arity)))
    return found


def _is_top(level: int, arity: int) -> Column:
    """Whether a node is the last one of its group: at this level one node holds all leaves."""
    below = F.col("n") > arity ** (level - 1) if level else F.lit(True)
    return below & (F.col("n") <= arity ** level)


def tops(tree: list[DataFrame], arity: int = ARITY) -> DataFrame:
    """grp and hash of the node that remains of each group."""
    found = [nodes.where(_is_top(i, arity)).select("grp", "hash") for i, nodes in enumerate(tree)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def paths(tree: list[DataFrame], crown: DataFrame, arity: int = ARITY) -> DataFrame:
    """The leaves of ``tree`` with ``path``: at each step up, the hashes left and right of the node.

    ``crown`` has grp and path of every group's last node, and columns to hand down.
    """
    down = [c for c in crown.columns if c not in ("grp", "path")]
    above: DataFrame | None = None
    for level in range(len(tree) - 1, -1, -1):
        nodes = tree[level]
        here = nodes.where(_is_top(level, arity)).join(crown, "grp")
        if above is not None:
            parent = above.select("grp", F.col("number").alias("bucket"), F.col("lo").alias("from"),
                                  F.col("hi").alias("to"), F.col("children").alias("family"),
                                  F.col("path").alias("further"), *down)
            inside = (nodes.where(F.col("n") > arity ** level).withColumn("bucket", _bucket(level, arity))
                      .join(parent, ["grp", "bucket"]).where("from <= lo and hi <= to"))
            left = F.filter("family", lambda c: c["hi"] <= F.col("lo"))
            right = F.filter("family", lambda c: c["lo"] >= F.col("hi"))
            step = F.struct(F.array_join(F.transform(left, lambda c: c["hash"]), "").alias("left"),
                            F.array_join(F.transform(right, lambda c: c["hash"]), "").alias("right"))
            inside = inside.withColumn("path", F.concat(F.array(step), "further"))
            here = here.unionByName(inside.select(*here.columns))
        above = here.withColumn("number", F.expr(f"lo div {arity ** level}"))
    return above.drop("number")


def no_steps() -> Column:
    return F.expr("cast(array() as array<struct<left: string, right: string>>)")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the hashes beside its path give."""
    return F.aggregate(path, leaf, lambda h, s: digest(s["left"], h, s["right"]))


def manifest(docs: DataFrame, group: str = "lang", key: str = "doc_id", fields: tuple[str, ...] = FIELDS,
             tampered: Callable[[DataFrame], Column] = third_of_ids,
             change: Callable[[DataFrame], dict[str, Column]] = lowered, arity: int = ARITY) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    The proof is the digest of all siblings from the leaf to the root. Where ``tampered``
    holds, the root is recomputed from the leaf of the changed fields and the original siblings.
    """
    hashed = written(leaves(docs, group, key, fields, tampered(docs), change(docs)))
    tree = levels(ranked(hashed, ["key", "hash"]), arity)
    groups = ranked(tops(tree, arity).select(F.lit("").alias("grp"), F.col("grp").alias("member"), "hash"), ["member"])
    upper = levels(groups, arity)
    root = tops(upper, arity).select("grp", no_steps().alias("path"), F.col("hash").alias("root"))
    crown = paths(upper, root, arity).select(F.col("member").alias("grp"), "path", F.col("hash").alias("subroot"),
                                             "root")
    found = paths(tree, crown, arity)
    beside = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    folded = fold(F.coalesce("altered", "hash"), F.col("path"))
    return found.select(
        F.col("key").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", "root",
        digest(beside).alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
