"""Change application."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as C
from ..operators.partitioned import PartitionedState
from . import derived as D
from .catalog import query
from .derived import stamp
from .streams import folder


@query("upsert_last_wins", """
    SELECT user_id, event_type, value FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC)
                AS rn
      FROM (SELECT c_custkey AS user_id, 'view' AS event_type, c_acctbal AS value,
                   TIMESTAMP '2024-01-10' AS ts, -1 AS event_id FROM customer
            UNION ALL SELECT user_id, event_type, value, ts, event_id FROM events)) WHERE rn = 1""")
def upsert_last_wins(t):
    cols = ["user_id", "event_type", "value", "ts", "event_id"]
    state = t.customer.select(F.col("c_custkey").alias("user_id"), F.lit("view").alias("event_type"),
                              F.col("c_acctbal").alias("value"),
                              D.ntz("2024-01-10 00:00:00").alias("ts"),
                              F.lit(-1).cast("bigint").alias("event_id"))
    new = C.upsert(state, t.events.select(*cols), ["user_id", "event_type"], ["ts", "event_id"])
    return new.select("user_id", "event_type", "value")


@query("merge_stored", """
    SELECT user_id, event_type, value FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC)
                AS rn
      FROM (SELECT c_custkey AS user_id, 'view' AS event_type, c_acctbal AS value,
                   TIMESTAMP '2024-01-10' AS ts, -1 AS event_id FROM customer
            UNION ALL SELECT user_id, event_type, value, ts, event_id FROM events)) WHERE rn = 1
    AND user_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)""")
def merge_stored(t):
    """The same state as a table of 16 hash partitions: two change sets, then the removal of some users."""
    state = PartitionedState(
        t.spark, folder(t, "state"), "user_id BIGINT, event_type STRING, value DOUBLE, ts TIMESTAMP_NTZ, "
        "event_id BIGINT", ("user_id", "event_type"), ("ts", "event_id"), 16, ("user_id",))
    state.create(t.customer.select(F.col("c_custkey").alias("user_id"), F.lit("view").alias("event_type"),
                                   F.col("c_acctbal").alias("value"), D.ntz("2024-01-10 00:00:00").alias("ts"),
                                   F.lit(-1).cast("bigint").alias("event_id")))
    changes = t.events.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    state.upsert(changes.filter("event_id % 2 = 0"))
    state.upsert(changes.filter("event_id % 2 <> 0"))
    state.delete(t.labels.filter("quality = 0").select(F.col("doc_id").alias("user_id")))
    return state.read().select("user_id", "event_type", "value")


@query("activate_exclusive", """
    SELECT c.id, c.config_type, c.model_name,
           CASE WHEN g.target IS NULL THEN c.is_active ELSE c.id = g.target END AS is_active
    FROM configs c LEFT JOIN (SELECT config_type, max(id) AS target FROM configs
      WHERE config_type IN ('type_1', 'type_2', 'type_3') GROUP BY config_type) g
      ON c.config_type = g.config_type""", ("configs",))
def activate_exclusive(t):
    """The newest configuration of three types is activated."""
    c = D.configs(t)
    targets = (c.filter(F.col("config_type").isin("type_1", "type_2", "type_3"))
               .groupBy("config_type").agg(F.max("id").alias("id")))
    return C.activate_exclusive(c, targets)


@query("delete_by_key", """
    SELECT id, filename FROM docs
    WHERE id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)""", ("docs",))
def delete_by_key(t):
    gone = t.labels.filter(F.col("quality") == 0).select(F.col("doc_id").alias("id"))
    return C.delete_keys(D.docs(t).select("id", "filename"), gone, ["id"])


def delete_requests(t):
    """One request per label, every third one by somebody else than the owner."""
    return t.labels.select(
        F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("session_id"),
        F.when(F.col("quality") == 1, F.col("doc_id") % 30)
        .otherwise((F.col("doc_id") + 1) % 30).alias("user_id"))


@query("delete_session_cascade", """
    WITH gone AS (SELECT s.session_id FROM sessions s JOIN labels l
      ON s.session_id = 's' || l.doc_id AND s.user_id = CASE WHEN l.quality = 1
         THEN l.doc_id % 30 ELSE (l.doc_id + 1) % 30 END)
    SELECT 'session' AS kind, session_id, 0::BIGINT AS message_id FROM sessions
    WHERE session_id NOT IN (SELECT session_id FROM gone)
    UNION ALL SELECT 'message', session_id, message_id FROM msgs
    WHERE session_id NOT IN (SELECT session_id FROM gone)""", ("sessions", "msgs"))
def delete_session_cascade(t):
    s, m = C.delete_sessions(D.sessions(t), D.msgs(t), delete_requests(t))
    return s.select(F.lit("session").alias("kind"), "session_id",
                    F.lit(0).cast("bigint").alias("message_id")).unionByName(
        m.select(F.lit("message").alias("kind"), "session_id", "message_id"))


@query("orphan_chunks", """
    SELECT doc_id, chunk_idx FROM chunks
    WHERE doc_id NOT IN (SELECT doc_id FROM labels)""", ("chunks",))
def orphan_chunks(t):
    """Documents without a label have been removed; their chunks are still in the index."""
    docs = t.labels.select(F.col("doc_id").alias("id"))
    return C.orphans(D.chunks(t), docs).select("doc_id", "chunk_idx")


@query("apply_feedback", """
    WITH ok AS (SELECT f.message_id, max_by(f.is_helpful, f.version) AS h,
                       max_by(f.note, f.version) AS note
                FROM feedback f JOIN msgs m ON f.message_id = m.message_id
                JOIN sessions s ON s.session_id = m.session_id AND s.user_id = f.user_id
                GROUP BY f.message_id)
    SELECT m.message_id, CASE WHEN ok.h IS NULL THEN 'unrated' WHEN ok.h THEN 'yes' ELSE 'no' END
             AS helpful, coalesce(ok.note, '') AS note
    FROM msgs m LEFT JOIN ok ON ok.message_id = m.message_id""", ("feedback", "msgs", "sessions"))
def apply_feedback(t):
    m = D.msgs(t)
    ok, _ = C.split_feedback(D.feedback(t), m, D.sessions(t))
    out = C.apply_feedback(m.select("message_id"), ok)
    return out.select("message_id", F.when(F.col("is_helpful").isNull(), "unrated")
                      .when(F.col("is_helpful"), "yes").otherwise("no").alias("helpful"),
                      F.coalesce("note", F.lit("")).alias("note"))


@query("touch_sessions", """
    WITH old AS (SELECT session_id, user_id FROM sessions WHERE user_id < 20),
    roll AS (SELECT session_id, max(created_at) AS updated_at,
                    substr(min_by(content, created_at) FILTER (WHERE role = 'user'), 1, 15) AS title
             FROM msgs GROUP BY session_id)
    SELECT s.session_id, s.user_id,
           CASE WHEN s.user_id < 20 THEN 'kept' ELSE coalesce(r.title, '新对话') END AS title,
           strftime(greatest(coalesce(r.updated_at, TIMESTAMP '2024-01-02'),
             CASE WHEN s.user_id < 20 THEN TIMESTAMP '2024-01-02'
                  ELSE TIMESTAMP '2000-01-01' END), '%Y-%m-%d %H:%M:%S') AS updated_at
    FROM sessions s JOIN roll r ON s.session_id = r.session_id""", ("sessions", "msgs"))
def touch_sessions(t):
    from ..operators.history import session_rollup

    s = D.sessions(t)
    roll = session_rollup(D.msgs(t))
    old = (s.filter(F.col("user_id") < 20).join(roll.select("session_id"), "session_id", "left_semi")
           .select("session_id", "user_id", F.lit("kept").alias("title"),
                   D.ntz("2024-01-02 00:00:00").alias("updated_at")))
    return C.touch_sessions(old, roll, s).withColumn("updated_at", stamp("updated_at"))
