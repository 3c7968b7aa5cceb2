"""Running counters and the daily token chart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import token_estimate


def running_counters(events: DataFrame, is_hit: Column) -> DataFrame:
    """(queries, hits) so far; write in complete mode."""
    return events.groupBy().agg(F.count("*").alias("queries"), F.count_if(is_hit).alias("hits"))


def counts_by(events: DataFrame, key: str) -> DataFrame:
    """(key, n) so far; write in update or complete mode."""
    return events.groupBy(key).agg(F.count("*").alias("n"))


def daily_tokens(msgs: DataFrame, lateness: str = "1 day") -> DataFrame:
    """(day, role, tokens). Messages later than ``lateness`` are dropped; a closed
    day is emitted once in append mode."""
    m = msgs.withColumn("ts", F.col("created_at").cast("timestamp")).withWatermark("ts", lateness)
    return (m.groupBy(F.window("ts", "1 day").alias("w"), "role")
            .agg(F.sum(token_estimate(F.col("content"))).alias("tokens"))
            .select(F.to_date("w.start").alias("day"), "role", "tokens"))


def drop_repeated_uploads(files: DataFrame, key: str = "filename") -> DataFrame:
    """First upload of every name, for the whole life of the stream."""
    return files.dropDuplicates([key])


def drop_recent_repeats(files: DataFrame, ts: str, window: str, key: str = "filename") -> DataFrame:
    """The same with bounded state: a name may return after ``window``."""
    return files.withWatermark(ts, window).dropDuplicatesWithinWatermark([key])
