"""Filters and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import params as P
from ..functions import text as X
from ..functions.arrays import non_empty
from ..operators import chunking as K
from ..operators import dashboard as B
from ..operators import graph as G
from ..operators import joins as JN
from . import derived as D
from .catalog import query
from .derived import stamp


@query("filter_user_msgs", """
    SELECT message_id, session_id, content FROM msgs WHERE role = 'user' AND turn > 0""", ("msgs",))
def filter_user_msgs(t):
    return (D.msgs(t).filter((F.col("role") == "user") & (F.col("turn") > 0))
            .select("message_id", "session_id", "content"))


def as_of(msgs):
    return msgs.agg(F.max("created_at")).scalar()


@query("filter_last_7d", """
    SELECT message_id, role, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM msgs
    WHERE created_at >= (SELECT max(created_at) FROM msgs) - INTERVAL 7 DAYS""", ("msgs",))
def filter_last_7d(t):
    m = D.msgs(t)
    return B.recent(m, as_of(m)).select("message_id", "role", stamp("created_at").alias("created_at"))


@query("filter_text_len", """
    SELECT message_id, length(content) > 5 AS for_topics, length(content) > 100 AS for_quiz,
           length(content) >= 20 AS for_graph
    FROM msgs WHERE length(content) >= 15""", ("msgs",))
def filter_text_len(t):
    n = F.length("content")
    return D.msgs(t).filter(n >= P.MIN_CHUNK_CHARS).select(
        "message_id", (n > P.TOPIC_MIN_CHARS).alias("for_topics"),
        (n > P.QUIZ_MIN_CHARS).alias("for_quiz"), (n >= P.GRAPH_MIN_CHARS).alias("for_graph"))


@query("filter_nonempty_array", """
    SELECT doc_id, len(string_split(text, ' | ')) AS n FROM documents
    WHERE lang <> 'de' AND contains(text, ' | ')""")
def filter_nonempty_array(t):
    """parsed_content is null for some documents and empty for those without a separator."""
    arr = F.when(F.col("lang") != "de",
                 F.when(F.col("text").contains(" | "), F.split("text", r" \| "))
                 .otherwise(F.array().cast("array<string>")))
    d = t.documents.select("doc_id", arr.alias("parsed_content"))
    return d.filter(non_empty(F.col("parsed_content"))).select(
        "doc_id", F.size("parsed_content").cast("bigint").alias("n"))


@query("triples_valid", "SELECT id, s, cat_s, r, t, cat_t FROM triples", ("triples",))
def triples_valid(t):
    return G.valid_triples(D.raw_triples(t)).drop("pos")


@query("filter_toc", """
    SELECT doc_id, md5(text) AS h FROM (
      SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '目 次' ELSE '正文' END AS path,
             CASE WHEN doc_id % 13 = 0 THEN '第一章........3 ' || text ELSE text END AS text
      FROM documents)
    WHERE NOT (contains(path, '目 次') OR contains(text, '........'))""")
def filter_toc(t):
    d = t.documents.select(
        "doc_id", F.when(F.col("doc_id") % 11 == 0, "目 次").otherwise("正文").alias("path"),
        F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit("第一章........3 "), F.col("text")))
        .otherwise(F.col("text")).alias("text"))
    return (d.filter(~K.is_toc(F.col("path"), F.col("text")))
            .select("doc_id", F.md5("text").alias("h")))


@query("null_defaults", """
    SELECT doc_id, coalesce(q, '') AS content, coalesce(n, 0) AS chunk_count FROM (
      SELECT d.doc_id, CASE WHEN l.quality = 1 THEN d.text END AS q, l.quality::BIGINT AS n
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""")
def null_defaults(t):
    j = t.documents.select("doc_id", "text").join(t.labels, "doc_id", "left")
    return j.select("doc_id",
                    F.coalesce(F.when(F.col("quality") == 1, F.col("text")), F.lit(""))
                    .alias("content"),
                    F.coalesce(F.col("quality").cast("bigint"), F.lit(0)).alias("chunk_count"))


@query("chunk_enrich", """
    SELECT doc_id, chunk_idx, '【章节】: ' || coalesce(path, '通用正文') || ' | 【' ||
           coalesce(nullif(regexp_extract(text, '第[一-龥\\p{Nd}]+条', 0), ''), '明细条款') ||
           '】' || chr(10) || text AS text
    FROM (SELECT doc_id, chunk_idx, CASE WHEN doc_id % 4 > 0 THEN 'part ' || doc_id END AS path,
                 CASE WHEN doc_id % 2 = 0 THEN '依据第' || doc_id || '条规定 ' || text
                      ELSE text END AS text
          FROM chunks)""", ("chunks",))
def chunk_enrich(t):
    c = D.chunks(t).select(
        "doc_id", "chunk_idx",
        F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("part "), F.col("doc_id").cast("string")))
        .alias("path"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("依据第"), F.col("doc_id").cast("string"),
                                                  F.lit("条规定 "), F.col("text")))
        .otherwise(F.col("text")).alias("text"))
    return c.select("doc_id", "chunk_idx", K.enrich(F.col("path"), F.col("text")).alias("text"))


@query("pref_overlay", """
    SELECT p.user_id, coalesce(nullif(p.llm_model, ''), c.model_name) AS llm_model
    FROM prefs p CROSS JOIN (
      SELECT min_by(model_name, id) AS model_name FROM configs
      WHERE config_type = 'type_1' AND is_active) c""", ("prefs", "configs"))
def pref_overlay(t):
    active = (D.configs(t).filter((F.col("config_type") == "type_1") & F.col("is_active"))
              .agg(F.min_by("model_name", "id")).scalar())
    return D.prefs(t).select("user_id", JN.falsy_overlay(F.col("ai_preferences")["llm_model"], active)
                             .alias("llm_model"))


@query("status_label", """
    SELECT id, CASE WHEN is_active IS DISTINCT FROM false THEN 'normal' ELSE 'disabled' END AS label
    FROM users""", ("users",))
def status_label(t):
    off = F.col("is_active").eqNullSafe(F.lit(False))
    return D.users(t).select("id", F.when(~off, "normal").otherwise("disabled").alias("label"))


@query("dashboard_record")
def dashboard_record(t):
    m = D.msgs(t)
    docs = K.chunk_counts(D.docs(t).select("id"), D.chunks(t))
    return B.record(D.users(t), D.sessions(t), m, docs, t.events,
                    F.col("event_type") == "view", as_of(m))
