"""Chat history: tails, speakers, transcripts, sessions by inactivity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import params as P
from ..functions import text as X
from .ranking import top_n


def last_n(msgs: DataFrame, n: int = P.HISTORY_READ, key: str = "session_id",
           order: str = "turn") -> DataFrame:
    """Last ``n`` rows per key, with their 0-based position in that tail."""
    tail = top_n(msgs, [key], [F.desc(order)], n, "_from_end")
    pos = W.partitionBy(key).orderBy(order)
    return tail.drop("_from_end").withColumn("pos", F.row_number().over(pos) - 1)


def speaker_by_position(tail: DataFrame) -> DataFrame:
    """Even positions are the user, odd ones the assistant."""
    return tail.withColumn("speaker", F.when(F.col("pos") % 2 == 0, P.USER_LABEL)
                           .otherwise(P.AI_LABEL))


def transcripts(msgs: DataFrame, n: int = P.HISTORY_READ) -> DataFrame:
    """One text per session out of its last ``n`` messages, each prefixed once."""
    tail = last_n(msgs, n).withColumn("line", X.speaker_line(F.col("role"), F.col("content")))
    return (tail.groupBy("session_id")
            .agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("ls"))
            .select("session_id",
                    F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("history")))


def inactivity_sessions(events: DataFrame, key: str, ts: str,
                        gap_seconds: int = P.HISTORY_TTL_SECONDS) -> DataFrame:
    """(key, session_start, last_ts, n): a gap of ``gap_seconds`` or more starts a new session.

    Events of one key in the same gap-wide slot are always in one session, so
    they are counted per slot first (map-side). What is left per key is bounded
    by the time span, however many events the key has.
    """
    slots = slot_counts(events, key, ts, gap_seconds)
    numbered = slot_sessions(slots, key, gap_seconds)
    return numbered.groupBy(key, "session_start").agg(F.max("last_ts").alias("last_ts"),
                                                      F.sum("n").alias("n"))


def slot_counts(events: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return (events.groupBy(key, F.floor(micros / (gap_seconds * 1_000_000)).alias("slot"))
            .agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n")))


def slot_sessions(slots: DataFrame, key: str, gap_seconds: int) -> DataFrame:
    w = W.partitionBy(key).orderBy("slot")
    gap = (F.unix_micros(F.col("first_ts").cast("timestamp"))
           - F.unix_micros(F.lag("last_ts").over(w).cast("timestamp")))
    starts = slots.withColumn("_start", F.when(gap.isNull() | (gap >= gap_seconds * 1_000_000),
                                               F.col("first_ts")))
    carried = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    return starts.withColumn("session_start", F.last("_start", ignorenulls=True).over(carried)) \
        .drop("_start")


def live_history(events: DataFrame, key: str, ts: str, order: str,
                 n: int = P.HISTORY_STORED, gap_seconds: int = P.HISTORY_TTL_SECONDS) -> DataFrame:
    """Last ``n`` events of the latest session of every key (what a TTL'd history holds)."""
    sessions = slot_sessions(slot_counts(events, key, ts, gap_seconds), key, gap_seconds)
    latest = sessions.groupBy(key).agg(F.max("session_start").alias("session_start"))
    tail = top_n(events, [key], [F.desc(ts), F.desc(order)], n, "back")
    return tail.join(latest, key).filter(F.col(ts) >= F.col("session_start"))


def session_rollup(msgs: DataFrame) -> DataFrame:
    """Session rows out of messages: updated_at, title of the first user question."""
    first = F.min_by(F.when(F.col("role") == "user", F.col("content")),
                     F.when(F.col("role") == "user", F.struct("created_at", "message_id")))
    return (msgs.groupBy("session_id")
            .agg(F.max("created_at").alias("updated_at"), first.alias("first_question"))
            .select("session_id", "updated_at",
                    F.coalesce(X.session_title(F.col("first_question")),
                               F.lit(P.DEFAULT_TITLE)).alias("title")))


def assemble_answers(frames: DataFrame) -> DataFrame:
    """One row per finished stream: content in order, the last sources seen."""
    from .concat import concat_ordered

    meta = (frames.groupBy("stream_id")
            .agg(F.max_by("data", F.when(F.col("type") == "sources", F.col("seq"))).alias("sources"),
                 F.max((F.col("type") == "done").cast("int")).alias("finished"))
            .filter(F.col("finished") == 1))
    content = concat_ordered(frames.filter(F.col("type") == "content"), ["stream_id"], "seq",
                             "data", sep="")
    return (meta.join(content, "stream_id", "left")
            .select("stream_id", F.coalesce("data", F.lit("")).alias("content"),
                    F.coalesce("sources", F.lit("[]")).alias("sources")))
