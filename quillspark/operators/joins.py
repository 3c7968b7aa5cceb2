"""Lookups and overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P


def two_tier_lookup(requests: DataFrame, key: str, first: DataFrame, second: DataFrame) -> DataFrame:
    """Value of the first table, else of the second, else null; (name, loc) on both sides."""
    def unique(df, out):
        return (df.groupBy("name").agg(F.min("loc").alias(out))
                .withColumnRenamed("name", f"_{out}"))

    a, b = unique(first, "loc1"), unique(second, "loc2")
    return (requests.join(a, requests[key] == a["_loc1"], "left")
            .join(b, requests[key] == b["_loc2"], "left")
            .withColumn("loc", F.coalesce("loc1", "loc2"))
            .withColumn("tier", F.when(F.col("loc1").isNotNull(), 1)
                        .when(F.col("loc2").isNotNull(), 2).otherwise(0))
            .drop("loc1", "loc2", "_loc1", "_loc2"))


def falsy_overlay(user_value, default):
    """The user's value unless null or empty."""
    return F.coalesce(F.nullif(user_value, F.lit("")), default)


def merge_prefs(prefs, defaults: dict[str, str] = P.DEFAULT_PREFS):
    """Map overlay, the user's entries win; null means no entries."""
    entries = [x for kv in defaults.items() for x in map(F.lit, kv)]
    base = F.create_map(*entries)
    own = F.coalesce(prefs, F.create_map().cast("map<string,string>"))
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k))
    return F.map_concat(kept, own)


def corpus(*parts: DataFrame) -> DataFrame:
    """Several sets of chunk rows as one corpus."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def explode_content(docs: DataFrame) -> DataFrame:
    """Documents with a non-empty chunk array -> one row per chunk."""
    return (docs.filter(F.col("parsed_content").isNotNull() & (F.size("parsed_content") > 0))
            .select("id", F.posexplode("parsed_content").alias("chunk_idx", "text")))


def warmup_set(topics: DataFrame, cached: DataFrame, k: int = 5) -> DataFrame:
    """Representative questions of the ``k`` biggest topics that have no cached answer yet."""
    top = topics.orderBy(F.desc("hit_count"), "topic_id").limit(k)
    q = top.select("topic_id", F.explode("representative_queries").alias("question"))
    return q.join(cached.select("question").distinct(), "question", "left_anti")
