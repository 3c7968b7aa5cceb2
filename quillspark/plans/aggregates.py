"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking as K
from ..operators import dashboard as B
from ..operators import quiz as Q
from ..operators import topics as TP
from . import derived as D
from .catalog import query
from .filters import as_of
from .joins import graph_tables


@query("dashboard_counts", """
    SELECT (SELECT count(*) FROM users) AS users, (SELECT count(*) FROM sessions) AS sessions,
           (SELECT count(*) FROM msgs) AS messages, (SELECT count(*) FROM docs) AS docs
    """, ("users", "sessions", "msgs", "docs"))
def dashboard_counts(t):
    def n(df):
        return df.agg(F.count("*")).scalar()

    return t.spark.range(1).select(n(D.users(t)).alias("users"), n(D.sessions(t)).alias("sessions"),
                                   n(D.msgs(t)).alias("messages"), n(D.docs(t)).alias("docs"))


@query("total_chunks", """
    SELECT coalesce(sum(n), 0)::BIGINT AS total_chunks
    FROM (SELECT count(*) AS n FROM chunks GROUP BY doc_id)""", ("chunks",))
def total_chunks(t):
    return B.total_chunks(K.chunk_counts(D.docs(t).select("id"), D.chunks(t)))


@query("quiz_user_stats", """
    SELECT user_id, count(*) AS total, count(*) FILTER (WHERE ok) AS correct_count,
           round_even(CAST(count(*) FILTER (WHERE ok)::DOUBLE / count(*)::DOUBLE * 100
                           AS DECIMAL(38,6)), 1)::DOUBLE AS correct_rate
    FROM (SELECT user_id, upper(user_answer) = upper(correct_answer) AS ok
          FROM answers a JOIN questions q ON a.question_id = q.id) GROUP BY user_id""",
       ("answers", "questions"))
def quiz_user_stats(t):
    return B.answer_stats(Q.grade(D.answers(t), D.questions(t)))


TOKENS_SQL = """
    WITH lim AS (SELECT max(created_at) AS now FROM msgs),
    spine AS (SELECT CAST(CAST(now AS DATE) - CAST(i AS INTEGER) AS DATE) AS d
              FROM lim, range(0, 7) AS r(i)),
    est AS (SELECT CAST(created_at AS DATE) AS d, role, floor(length(content) * 1.5)::BIGINT AS n
            FROM msgs, lim WHERE created_at >= now - INTERVAL 7 DAYS),
    days AS (SELECT strftime(spine.d, '%m-%d') AS day,
                    coalesce(sum(n) FILTER (WHERE role = 'user'), 0)::BIGINT AS input_tokens,
                    coalesce(sum(n) FILTER (WHERE role = 'ai'), 0)::BIGINT AS output_tokens
             FROM spine LEFT JOIN est ON spine.d = est.d GROUP BY spine.d)
    """


@query("tokens_7d", TOKENS_SQL + "SELECT * FROM days", ("msgs",))
def tokens_7d(t):
    m = D.msgs(t)
    return B.tokens_last_days(m, as_of(m))


@query("token_cost", TOKENS_SQL + """
    SELECT sum(input_tokens + output_tokens)::BIGINT AS total_tokens,
           round_even(CAST(sum(input_tokens + output_tokens)::DOUBLE / 1000.0::DOUBLE
                           * 0.002::DOUBLE AS DECIMAL(38,6)), 4)::DOUBLE AS estimated_cost
    FROM days""", ("msgs",))
def token_cost(t):
    m = D.msgs(t)
    return B.token_cost(B.tokens_last_days(m, as_of(m)))


@query("tokens_daily", """
    SELECT strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS day,
           coalesce(sum(floor(length(content) * 1.5)) FILTER (WHERE role = 'user'), 0)::BIGINT
             AS input_tokens,
           coalesce(sum(floor(length(content) * 1.5)) FILTER (WHERE role = 'ai'), 0)::BIGINT
             AS output_tokens
    FROM msgs GROUP BY CAST(created_at AS DATE)""", ("msgs",))
def tokens_daily(t):
    return B.daily_tokens(D.msgs(t)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("cache_hit_rate", """
    SELECT count(*) AS queries, count(*) FILTER (WHERE event_type = 'view') AS hits,
           round_even(CAST(count(*) FILTER (WHERE event_type = 'view')::DOUBLE / count(*)::DOUBLE
                           * 100 AS DECIMAL(38,6)), 1)::DOUBLE AS hit_rate FROM events""")
def cache_hit_rate(t):
    return B.cache_hit_rate(t.events, F.col("event_type") == "view")


@query("graph_categories", "SELECT DISTINCT category FROM nodes", ("nodes",))
def graph_categories(t):
    return graph_tables(t)[0].select("category").distinct()


def labelled_messages(t):
    """User messages with a topic cluster: the label of the vector with the message's number."""
    n = t.embeddings.agg(F.count("*")).scalar()
    m = TP.topic_messages(D.msgs(t)).withColumn("vec_id", F.col("message_id") % n)
    return m.join(t.embeddings.select("vec_id", F.col("label").cast("bigint").alias("cluster")),
                  "vec_id")


D.add_ctes(clustered=(("msgs",), """
    SELECT m.*, e.label::BIGINT AS cluster FROM msgs m JOIN embeddings e
      ON e.vec_id = m.message_id % (SELECT count(*) FROM embeddings)
    WHERE m.role = 'user' AND length(m.content) > 5"""))


@query("cluster_representatives", """
    SELECT cluster, count(*) AS hit_count,
           string_agg(content, chr(10) ORDER BY message_id) FILTER (WHERE rn <= 3)
             AS representative_queries
    FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY message_id) AS rn
          FROM clustered) GROUP BY cluster""", ("clustered",))
def cluster_representatives(t):
    r = TP.representatives(labelled_messages(t), ["message_id"])
    return r.withColumn("representative_queries", F.array_join("representative_queries", "\n"))


@query("topic_sizes", "SELECT label AS cluster, count(*) AS hit_count FROM embeddings GROUP BY label")
def topic_sizes(t):
    return t.embeddings.groupBy(F.col("label").alias("cluster")).agg(F.count("*").alias("hit_count"))


@query("user_profile_stats", """
    SELECT u.id, greatest(floor(epoch((SELECT max(created_at) FROM msgs) - u.created_at) / 86400),
                          1)::BIGINT AS join_days,
           count(m.message_id) AS query_count
    FROM users u LEFT JOIN sessions s ON s.user_id = u.id
    LEFT JOIN (SELECT * FROM msgs WHERE role = 'user') m ON m.session_id = s.session_id
    GROUP BY u.id, u.created_at""", ("users", "sessions", "msgs"))
def user_profile_stats(t):
    m = D.msgs(t)
    return B.user_profile(D.users(t), D.sessions(t), m, as_of(m))


@query("quiz_score_band", """
    SELECT user_id, score, CASE WHEN score = 100 THEN 'perfect' WHEN score >= 80 THEN 'excellent'
                                WHEN score >= 60 THEN 'pass' ELSE 'fail' END AS band
    FROM (SELECT user_id, CAST(10 * sum(CASE WHEN upper(user_answer) = upper(correct_answer)
                                             THEN 1 ELSE 0 END) AS BIGINT) AS score
          FROM answers a JOIN questions q ON a.question_id = q.id GROUP BY user_id)""",
       ("answers", "questions"))
def quiz_score_band(t):
    g = Q.grade(D.answers(t), D.questions(t))
    s = g.groupBy("user_id").agg(F.sum(F.when(F.col("is_correct"), F.lit(10)).otherwise(F.lit(0)))
                                 .alias("score"))
    return s.select("user_id", "score", B.score_band(F.col("score")).alias("band"))
