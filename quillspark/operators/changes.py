"""State table + change table -> new state table (usable in foreachBatch)."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P


def last_change(changes: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Latest row per key; ``max_by`` combines map-side, so a hot key is no hot task."""
    values = [c for c in changes.columns if c not in keys]
    latest = changes.groupBy(*keys).agg(
        F.max_by(F.struct(*values), F.struct(*version)).alias("_row"))
    return latest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in values])


def upsert(state: DataFrame, changes: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Both sides carry the version columns; the last change wins, over an equal version in the state too.

    Keys are unique in the state, which is read once: it meets the last change of each key in one full join.
    """
    columns = state.columns
    last = last_change(changes, keys, version).select(F.struct(*columns).alias("new"))
    held = state.select(F.struct(*columns).alias("old"))
    same = reduce(and_, [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys])
    order = [F.struct(*[F.col(f"{side}.{v}") for v in version]) for side in ("new", "old")]
    wins = F.col("old").isNull() | (F.col("new").isNotNull() & (order[0] >= order[1]))
    return (held.join(last, same, "full").select(F.when(wins, F.col("new")).otherwise(F.col("old")).alias("row"))
            .select("row.*"))


def activate_exclusive(configs: DataFrame, targets: DataFrame) -> DataFrame:
    """(id) to activate: it becomes active, all others of its type inactive."""
    chosen = (configs.join(targets.select(F.col("id")), "id", "left_semi")
              .groupBy("config_type").agg(F.max("id").alias("target")))
    return (configs.join(chosen, "config_type", "left")
            .withColumn("is_active", F.when(F.col("target").isNull(), F.col("is_active"))
                        .otherwise(F.col("id") == F.col("target")))
            .select(*configs.columns))


def delete_keys(state: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return state.join(keys.select(*on), on, "left_anti")


def delete_sessions(sessions: DataFrame, msgs: DataFrame, requests: DataFrame):
    """(session_id, user_id) requests; only the owner's request removes a session and its messages."""
    allowed = requests.join(sessions, ["session_id", "user_id"], "left_semi").select("session_id")
    return (sessions.join(allowed, "session_id", "left_anti"),
            msgs.join(allowed, "session_id", "left_anti"))


def orphans(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks whose document is gone."""
    return chunks.join(docs.select(F.col("id").alias("doc_id")), "doc_id", "left_anti")


def purge_orphans(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    return chunks.join(docs.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")


def split_feedback(feedback: DataFrame, msgs: DataFrame, sessions: DataFrame):
    """Feedback counts only for messages in the submitting user's own sessions."""
    owners = (msgs.select("message_id", "session_id").join(sessions, "session_id")
              .select("message_id", "user_id"))
    on = ["message_id", "user_id"]
    return feedback.join(owners, on, "left_semi"), feedback.join(owners, on, "left_anti")


def apply_feedback(msgs: DataFrame, accepted: DataFrame) -> DataFrame:
    """Last feedback per message; presence decides, so false overwrites true."""
    last = last_change(accepted.select("message_id", "is_helpful", "note", "version"),
                       ["message_id"], ["version"]).drop("version")
    return msgs.join(last, "message_id", "left")


def touch_sessions(sessions: DataFrame, rollup: DataFrame, owners: DataFrame) -> DataFrame:
    """Existing sessions get a new updated_at; missing ones are created with a title."""
    merged = sessions.select("session_id", F.col("user_id").alias("_u"), F.col("title").alias("_t"),
                             F.col("updated_at").alias("_a")).join(rollup, "session_id", "full")
    return (merged.join(owners.select("session_id", F.col("user_id").alias("_owner")), "session_id",
                        "left")
            .select("session_id", F.coalesce("_u", "_owner").alias("user_id"),
                    F.coalesce("_t", "title", F.lit(P.DEFAULT_TITLE)).alias("title"),
                    F.greatest("_a", "updated_at").alias("updated_at")))
