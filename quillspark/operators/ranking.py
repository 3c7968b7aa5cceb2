"""Per-key and global top-n, samples and global ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import stable_hash


def top_n(df: DataFrame, keys: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key. The rank filter lets Spark cut every key to ``n``
    rows before the shuffle (WindowGroupLimit), so a hot key costs no more."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return top_n(df, keys, order, 1, "_rn").drop("_rn")


def sample_n(df: DataFrame, key: str, n: int, seed: str | int) -> DataFrame:
    """``n`` rows in hash order of ``key``: a repeatable random sample (TakeOrdered)."""
    return df.orderBy(stable_hash(F.col(key), seed), key).limit(n)


def sample_per_key(df: DataFrame, keys: list[str], key: str, n: int, seed: str | int,
                   rank: str = "rank") -> DataFrame:
    return top_n(df.withColumn("_h", stable_hash(F.col(key), seed)), keys, ["_h", key], n,
                 rank).drop("_h")


def global_rank(df: DataFrame, key: str, seed: str | int, digits: int = 3,
                out: str = "rank") -> DataFrame:
    """1-based rank of every row in hash order without a single-task sort.

    Rows are ranked inside ``16 ** digits`` hash buckets; the buckets' offsets
    come from one small count per bucket, the only rows that meet in one task.
    """
    h = df.withColumn("_h", stable_hash(F.col(key), seed))
    h = h.withColumn("_b", F.substring("_h", 1, digits))
    counts = h.groupBy("_b").agg(F.count("*").alias("_n"))
    before = W.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = W.partitionBy("_b").orderBy("_h", key)
    return (h.withColumn("_rn", F.row_number().over(inside))
            .join(F.broadcast(offsets), "_b")  # at most 16 ** digits rows
            .withColumn(out, F.col("_off") + F.col("_rn"))
            .drop("_h", "_b", "_rn", "_off"))
