"""Sorts, limits, top-k and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as JN
from ..operators import quiz as Q
from ..operators import ranking as R
from ..operators import topics as TP
from . import derived as D
from .aggregates import labelled_messages
from .catalog import query
from .derived import stamp
from .joins import UNSEEN, quiz_users


@query("sessions_recent", """
    SELECT s.user_id, s.session_id, strftime(max(m.created_at), '%Y-%m-%d %H:%M:%S') AS updated_at
    FROM sessions s JOIN msgs m ON m.session_id = s.session_id GROUP BY s.user_id, s.session_id
    ORDER BY s.user_id, updated_at DESC, s.session_id""", ("sessions", "msgs"))
def sessions_recent(t):
    """Every user's sessions, the latest first. One range-partitioned sort: a user
    with very many sessions spans several tasks."""
    last = D.msgs(t).groupBy("session_id").agg(F.max("created_at").alias("updated_at"))
    return (D.sessions(t).join(last, "session_id")
            .select("user_id", "session_id", stamp("updated_at").alias("updated_at"))
            .orderBy("user_id", F.desc("updated_at"), "session_id"))


@query("history_ordered", """
    SELECT session_id, message_id, role, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at
    FROM msgs ORDER BY session_id, created_at, message_id""", ("msgs",))
def history_ordered(t):
    """Every session's messages, the oldest first."""
    return (D.msgs(t).select("session_id", "message_id", "role", stamp("created_at").alias("created_at"))
            .orderBy("session_id", "created_at", "message_id"))


@query("top_topics", """
    SELECT cluster, count(*) AS hit_count FROM clustered GROUP BY cluster
    ORDER BY hit_count DESC, cluster LIMIT 5""", ("clustered",))
def top_topics(t):
    sizes = labelled_messages(t).groupBy("cluster").agg(F.count("*").alias("hit_count"))
    return sizes.orderBy(F.desc("hit_count"), "cluster").limit(5)


@query("sample_chunks", """
    SELECT doc_id, chunk_idx, text FROM chunks
    ORDER BY md5(doc_id || '-' || chunk_idx || '#graph'), doc_id, chunk_idx LIMIT 15""", ("chunks",))
def sample_chunks(t):
    c = D.chunks(t).withColumn("k", F.concat_ws("-", F.col("doc_id").cast("string"),
                                                F.col("chunk_idx").cast("string")))
    return R.sample_n(c, "k", 15, "graph").drop("k")


@query("active_config", """
    SELECT config_type, min(id) AS id, min_by(model_name, id) AS model_name
    FROM configs WHERE is_active GROUP BY config_type""", ("configs",))
def active_config(t):
    return (D.configs(t).filter("is_active").groupBy("config_type")
            .agg(F.min("id").alias("id"), F.min_by("model_name", "id").alias("model_name")))


@query("daily_quiz", """
    WITH unseen AS (""" + UNSEEN + """),
    seen AS (SELECT user_id, question_id,
                    row_number() OVER (PARTITION BY user_id
                                       ORDER BY md5(question_id || '#daily'), question_id) AS o
             FROM (SELECT DISTINCT user_id, question_id FROM answers
                   WHERE question_id IN (SELECT id FROM questions)
                     AND user_id IN (SELECT c_custkey FROM customer)))
    SELECT user_id, question_id, pool, pos FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pool, o) AS pos FROM (
        SELECT user_id, question_id, 0 AS pool, pos AS o FROM unseen
        UNION ALL SELECT user_id, question_id, 1, o FROM seen)) WHERE pos <= 10""",
       ("questions", "answers"))
def daily_quiz(t):
    d = Q.daily_pick(quiz_users(t), D.questions(t), D.answers(t))
    return d.withColumn("pos", F.col("pos").cast("bigint"))


@query("warmup_set", """
    WITH top AS (SELECT cluster, count(*) AS n FROM clustered GROUP BY cluster
                 ORDER BY n DESC, cluster LIMIT 5),
    reps AS (SELECT c.cluster, c.content,
                    row_number() OVER (PARTITION BY c.cluster ORDER BY c.message_id) AS rn
             FROM clustered c JOIN top USING (cluster))
    SELECT cluster AS topic_id, content AS question FROM reps
    WHERE rn <= 3 AND content NOT IN (SELECT content FROM msgs WHERE role = 'ai')""",
       ("clustered", "msgs"))
def warmup_set(t):
    topics = TP.representatives(labelled_messages(t), ["message_id"]).withColumnRenamed(
        "cluster", "topic_id")
    cached = D.msgs(t).filter(F.col("role") == "ai").select(F.col("content").alias("question"))
    return JN.warmup_set(topics, cached).select("topic_id", "question")
