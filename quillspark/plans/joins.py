"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as C
from ..operators import dashboard as B
from ..operators import graph as G
from ..operators import joins as JN
from ..operators import quiz as Q
from ..session import written
from . import derived as D
from .catalog import query


@query("top_users", """
    SELECT row_number() OVER (ORDER BY msg_count DESC, username) AS rank, username, msg_count
    FROM (SELECT u.username, count(*) AS msg_count
          FROM users u JOIN sessions s ON u.id = s.user_id
          JOIN msgs m ON m.session_id = s.session_id
          WHERE m.role = 'user' GROUP BY u.username
          ORDER BY msg_count DESC, u.username LIMIT 5)""", ("users", "sessions", "msgs"))
def top_users(t):
    return B.top_users(D.users(t), D.sessions(t), D.msgs(t)).select(
        F.col("rank").cast("bigint").alias("rank"), "username", "msg_count")


@query("user_query_count", """
    SELECT s.user_id, count(m.message_id) AS query_count
    FROM sessions s LEFT JOIN (SELECT * FROM msgs WHERE role = 'user') m
      ON m.session_id = s.session_id GROUP BY s.user_id""", ("sessions", "msgs"))
def user_query_count(t):
    return B.user_query_counts(D.sessions(t), D.msgs(t))


def quiz_users(t):
    return t.customer.select(F.col("c_custkey").alias("user_id"))


UNSEEN = """
    SELECT user_id, question_id, pos FROM (
      SELECT c.c_custkey AS user_id, q.id AS question_id,
             row_number() OVER (PARTITION BY c.c_custkey
                                ORDER BY md5(q.id || '#daily'), q.id) AS pos
      FROM customer c CROSS JOIN questions q
      WHERE NOT EXISTS (SELECT 1 FROM answers a
                        WHERE a.user_id = c.c_custkey AND a.question_id = q.id)) WHERE pos <= 10"""


@query("unanswered", UNSEEN, ("questions", "answers"))
def unanswered(t):
    return Q.unanswered(quiz_users(t), D.questions(t), D.answers(t)).withColumn(
        "pos", F.col("pos").cast("bigint"))


@query("review_pool", """
    SELECT DISTINCT user_id, question_id FROM answers
    WHERE question_id IN (SELECT id FROM questions)
      AND user_id IN (SELECT c_custkey FROM customer)""", ("questions", "answers"))
def review_pool(t):
    return Q.review_pool(quiz_users(t), D.questions(t), D.answers(t))


def graph_tables(t):
    tr = G.valid_triples(D.raw_triples(t))
    return G.nodes(tr), G.edges(tr)


def stored_links(t):
    """The graph as stored tables: the responses are parsed once for all that reads it."""
    tr = written(G.valid_triples(D.raw_triples(t)))
    return written(G.links(G.edges(tr), G.nodes(tr)))


@query("graph_links", """
    SELECT a.name AS source, e.relation AS value, b.name AS target
    FROM edges e JOIN nodes a ON e.source_id = a.node_id JOIN nodes b ON e.target_id = b.node_id
    """, ("nodes", "edges"))
def graph_links(t):
    return stored_links(t)


@query("edge_insert_if_absent", """
    SELECT source_id, target_id, relation FROM edges
    WHERE substr(source_id, 1, 1) NOT IN ('0','1','2','3','4')""", ("edges",))
def edge_insert_if_absent(t):
    """Edges of some sources are in the table already; the extraction brings every edge, twice."""
    edges = written(G.edges(G.valid_triples(D.raw_triples(t))))
    existing = edges.filter(F.substring("source_id", 1, 1).isin("0", "1", "2", "3", "4"))
    return G.insert_absent(existing, edges.unionByName(edges), G.EDGE_KEY)


D.add_ctes(
    g_links=(("nodes", "edges"), """
        SELECT a.name AS source, e.relation AS value, b.name AS target
        FROM edges e JOIN nodes a ON e.source_id = a.node_id JOIN nodes b ON e.target_id = b.node_id"""),
    g_names=(("g_links",), """
        SELECT name, count(*) AS links FROM (
          SELECT source AS name, * FROM g_links UNION SELECT target, * FROM g_links) GROUP BY name"""),
    g_tokens=(("queries_txt",), r"""
        SELECT DISTINCT qid, u.x AS token FROM queries_txt,
               UNNEST(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS u(x)"""),
    g_classes=(("g_tokens", "g_names"), """
        SELECT token, name, links FROM (SELECT DISTINCT token FROM g_tokens) JOIN g_names ON contains(name, token)"""),
    g_members=(("g_tokens", "g_classes"), """
        SELECT qid, token FROM g_tokens WHERE token IN (SELECT token FROM g_classes)"""),
)


@query("graph_context", """
    tok AS (SELECT DISTINCT qid, u.x AS token FROM queries_txt,
              UNNEST(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) AS u(x)),
    links AS (SELECT a.name AS source, e.relation AS value, b.name AS target
              FROM edges e JOIN nodes a ON e.source_id = a.node_id
              JOIN nodes b ON e.target_id = b.node_id),
    names AS (SELECT source AS name FROM links UNION SELECT target FROM links),
    hit AS (SELECT DISTINCT qid, name FROM tok JOIN names ON contains(name, token)),
    lines AS (SELECT DISTINCT qid, source || ' -' || value || '-> ' || target AS line
              FROM hit JOIN links ON hit.name = links.source OR hit.name = links.target)
    SELECT qid, line FROM lines
    UNION ALL SELECT qid, '暂无图谱逻辑关联' FROM queries_txt
    WHERE qid NOT IN (SELECT qid FROM lines)""".replace("tok AS", "WITH tok AS", 1),
       ("queries_txt", "nodes", "edges"))
def graph_context(t):
    """The links around every query's words as lines."""
    return graph_lines(D.queries_txt(t), stored_links(t))


@query("graph_context_links", """
    SELECT m.qid, count(DISTINCT (l.source, l.value, l.target)) AS links
    FROM g_members m JOIN g_classes c ON c.token = m.token
    JOIN g_links l ON c.name = l.source OR c.name = l.target GROUP BY m.qid""", ("g_members", "g_classes", "g_links"))
def graph_context_links(t):
    """The links around every query, counted from the expanded classes."""
    links = stored_links(t)
    members, classes = graph_classes(D.queries_txt(t), links)
    return G.expand(members, classes, links).groupBy("qid").agg(F.count("*").alias("links"))


def graph_classes(q, links):
    return G.context_classes(q, query_tokens(q), G.name_index(links))


def graph_lines(q, links):
    return G.expanded_lines(q, query_tokens(q), links)


def query_tokens(q):
    from ..functions.text import tokenize

    return q.select("qid", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("token"))


@query("feedback_authorised", """
    SELECT f.message_id, f.user_id, f.version, count(m.message_id) > 0 AS accepted
    FROM feedback f LEFT JOIN (msgs JOIN sessions USING (session_id)) m
      ON m.message_id = f.message_id AND m.user_id = f.user_id
    GROUP BY ALL""", ("feedback", "msgs", "sessions"))
def feedback_authorised(t):
    ok, rejected = C.split_feedback(D.feedback(t), D.msgs(t), D.sessions(t))
    cols = ["message_id", "user_id", "version"]
    return ok.select(*cols, F.lit(True).alias("accepted")).unionByName(
        rejected.select(*cols, F.lit(False).alias("accepted")))


@query("two_tier_lookup", """
    SELECT c.c_custkey, CASE WHEN p.loc IS NOT NULL THEN 1 WHEN g.loc IS NOT NULL THEN 2 ELSE 0 END
             AS tier, coalesce(p.loc, g.loc, 'none') AS loc
    FROM customer c
    LEFT JOIN (SELECT n_name AS name, 'poi ' || n_nationkey AS loc FROM nation
               WHERE n_nationkey % 3 = 0) p ON p.name = 'NATION_' || c.c_nationkey
    LEFT JOIN (SELECT 'NATION_' || s_nationkey AS name, min('geo ' || s_suppkey) AS loc
               FROM supplier WHERE s_nationkey % 2 = 0 GROUP BY 1) g
      ON g.name = 'NATION_' || c.c_nationkey""")
def two_tier_lookup(t):
    req = t.customer.select("c_custkey", F.concat(F.lit("NATION_"), F.col("c_nationkey")
                                                  .cast("string")).alias("address"))
    poi = t.nation.filter(F.col("n_nationkey") % 3 == 0).select(
        F.col("n_name").alias("name"),
        F.concat(F.lit("poi "), F.col("n_nationkey").cast("string")).alias("loc"))
    geo = t.supplier.filter(F.col("s_nationkey") % 2 == 0).select(
        F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("name"),
        F.concat(F.lit("geo "), F.col("s_suppkey").cast("string")).alias("loc"))
    return (JN.two_tier_lookup(req, "address", poi, geo)
            .select("c_custkey", "tier", F.coalesce("loc", F.lit("none")).alias("loc")))


# --- set operations ------------------------------------------------------

@query("corpus_extend", """
    SELECT doc_id, chunk_idx, text FROM chunks
    UNION ALL SELECT page_id AS doc_id, 0 AS chunk_idx, html AS text FROM pages""", ("chunks",))
def corpus_extend(t):
    pages = t.pages.select(F.col("page_id").alias("doc_id"), F.lit(0).alias("chunk_idx"),
                           F.col("html").alias("text"))
    return JN.corpus(D.chunks(t), pages)


PREF_SQL = """
    SELECT p.user_id, k.key, coalesce(CASE WHEN k.key = 'llm_model' THEN p.llm_model END,
                                      k.value) AS value
    FROM prefs p CROSS JOIN (VALUES
      ('llm_model', 'deepseek-chat'), ('llm_key', ''), ('embed_model', 'text-embedding-v4'),
      ('embed_key', ''), ('vision_model', 'qwen-vl-max'), ('vision_key', '')) AS k(key, value)"""


@query("pref_map_merge", PREF_SQL, ("prefs",))
def pref_map_merge(t):
    return D.prefs(t).select("user_id", F.explode(JN.merge_prefs(F.col("ai_preferences")))
                             .alias("key", "value"))
