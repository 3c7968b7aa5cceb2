"""Chunking, knowledge graph, topics and quiz."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import params as P
from ..functions import text as X
from ..operators import chunking as K
from ..operators import dense as DN
from ..operators import graph as G
from ..operators import quiz as Q
from ..operators import topics as TP
from . import derived as D
from .aggregates import labelled_messages
from .catalog import query
from .functions import strip_sql
from .joins import graph_tables

# --- chunks --------------------------------------------------------------


@query("page_batch_concat", """
    SELECT doc_id, CAST(page_no // 5 AS INTEGER) AS batch_no,
           string_agg(text, chr(10) || chr(10) ORDER BY page_no) || chr(10) || chr(10) AS text
    FROM pages_of GROUP BY doc_id, page_no // 5""", ("pages_of",))
def page_batch_concat(t):
    return K.page_batches(D.pages_of(t))


@query("page_join", r"""
    SELECT doc_id, regexp_replace(string_agg(text || chr(10) || chr(10), '' ORDER BY page_no),
           '([^.。：:；;!！?？>])' || chr(10) || '+([^' || chr(10) || '#*-])', '\1\2', 'g') AS text
    FROM (SELECT doc_id, b AS page_no,
                 string_agg(text, chr(10) || chr(10) ORDER BY page_no) AS text
          FROM (SELECT *, page_no // 5 AS b FROM pages_of) GROUP BY doc_id, b) GROUP BY doc_id
    """, ("pages_of",))
def page_join(t):
    return K.join_pages(D.pages_of(t))


@query("md_sections", r"""
    WITH s AS (SELECT *, sum(CASE WHEN lv > 0 AND pos > 0 THEN 1 ELSE 0 END)
                      OVER (PARTITION BY doc_id ORDER BY pos) AS section_no FROM md_lines),
    sec AS (SELECT doc_id, section_no, min(pos) AS pos,
                   string_agg(line, chr(10) ORDER BY pos) AS content,
                   min_by(title, pos) AS title, min_by(lv, pos) AS lv FROM s GROUP BY doc_id, section_no),
    p AS (SELECT *, max(CASE WHEN lv = 1 THEN section_no END) OVER w AS p1,
                 max(CASE WHEN lv = 2 THEN section_no END) OVER w AS p2,
                 max(CASE WHEN lv = 3 THEN section_no END) OVER w AS p3
          FROM sec WINDOW w AS (PARTITION BY doc_id ORDER BY section_no)),
    tt AS (SELECT doc_id, section_no, title FROM sec)
    SELECT p.doc_id, CAST(p.section_no AS INTEGER) AS section_no, p.content,
           coalesce(nullif(concat_ws(' > ', a.title,
             CASE WHEN p.p2 > coalesce(p.p1, -1) THEN b.title END,
             CASE WHEN p.p3 > greatest(coalesce(p.p1, -1), coalesce(p.p2, -1)) THEN c.title END), ''),
             '通用正文') AS path
    FROM p LEFT JOIN tt a ON a.doc_id = p.doc_id AND a.section_no = p.p1
           LEFT JOIN tt b ON b.doc_id = p.doc_id AND b.section_no = p.p2
           LEFT JOIN tt c ON c.doc_id = p.doc_id AND c.section_no = p.p3""", ("md_lines",))
def md_sections(t):
    return K.sections(D.md_text(t))


@query("chunk_fixed", "SELECT doc_id, chunk_idx, text FROM chunks", ("chunks",))
def chunk_fixed(t):
    return D.chunks(t)


@query("chunk_recursive")
def chunk_recursive(t):
    return K.recursive_chunks(t.texts.select("doc_id", "text"))


@query("chunk_recursive_shape", r"""
    SELECT doc_id, length(text) > 0 AS cut, true AS fits, true AS inside, true AS complete
    FROM (SELECT doc_id, """ + strip_sql("text") + r""" AS text FROM documents) WHERE text IS NOT NULL""")
def chunk_recursive_shape(t):
    """What must hold of any cut: sizes, order of the ends, chunks that are parts of the text, nothing left out."""
    rows = t.texts.where("text is not null").select("doc_id", X.strip(F.col("text")).alias("text"),
                                                    K.recursive_chunk_array()("text").alias("cs"))
    bare = F.regexp_replace("text", P.UNICODE_SPACE, "")
    length = F.aggregate("cs", F.lit(0), lambda n, c: n + F.length(F.regexp_replace(c, P.UNICODE_SPACE, "")))
    ends = F.col("text").startswith(F.get("cs", F.lit(0))) & F.col("text").endswith(F.element_at("cs", -1))
    return rows.select(
        "doc_id", (F.size("cs") > 0).alias("cut"),
        F.forall("cs", lambda c: F.length(c).between(1, P.CHUNK_SIZE)).alias("fits"),
        F.forall("cs", lambda c: F.col("text").contains(c)).alias("inside"),
        ((F.size("cs") == 0) | (ends & (length >= F.length(bare)))).alias("complete"))


CLAUSED = "CASE WHEN doc_id % 2 = 0 THEN '依据第' || doc_id || '条规定 ' || text ELSE text END"
CHUNK_BUILD = r"""
    WITH c AS (SELECT doc_id, chunk_idx, """ + strip_sql(CLAUSED) + r"""
             AS text FROM chunks)
    SELECT doc_id, chunk_idx, '通用正文' AS path, clause,
           '【章节】: 通用正文 | 【' || clause || '】' || chr(10) || text AS text
    FROM (SELECT *, coalesce(nullif(regexp_extract(text, '第[一-龥\p{Nd}]+条', 0), ''), '明细条款')
                    AS clause
          FROM (SELECT doc_id, chunk_idx,
                       regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g') AS text
                FROM c WHERE NOT contains(text, '........')))
    WHERE length(text) >= 15"""


@query("chunk_build", CHUNK_BUILD, ("chunks",))
def chunk_build(t):
    c = D.chunks(t).withColumn("path", F.lit(None).cast("string")).withColumn(
        "text", F.when(F.col("doc_id") % 2 == 0, F.concat(
            F.lit("依据第"), F.col("doc_id").cast("string"), F.lit("条规定 "), F.col("text")))
        .otherwise(F.col("text")))
    return K.build_chunks(c)


@query("chunk_documents")
def chunk_documents(t):
    return K.chunk_documents(D.md_text(t))


@query("doc_chunk_count", """
    SELECT doc_id, count(*) AS chunk_count, string_agg(text, '|' ORDER BY chunk_idx) AS parsed_content
    FROM chunks GROUP BY doc_id""", ("chunks",))
def doc_chunk_count(t):
    return K.write_back(D.chunks(t)).withColumn("parsed_content", F.array_join("parsed_content", "|"))


# --- graph ---------------------------------------------------------------

@query("graph_nodes", "SELECT node_id, name, category FROM nodes", ("nodes",))
def graph_nodes(t):
    return graph_tables(t)[0]


@query("graph_edges", "SELECT source_id, target_id, relation FROM edges", ("edges",))
def graph_edges(t):
    return graph_tables(t)[1]


@query("graph_neighbors", """
    SELECT DISTINCT focus, neighbour FROM (
      SELECT source_id AS focus, target_id AS neighbour FROM edges
      UNION ALL SELECT target_id, source_id FROM edges)""", ("edges",))
def graph_neighbors(t):
    return G.neighbours(graph_tables(t)[1])


# --- topics --------------------------------------------------------------

@query("kmeans_topics")
def kmeans_topics(t):
    m = TP.topic_messages(D.msgs(t)).select("message_id", "content")
    rows, _ = TP.cluster(DN.hash_embed(m, "content", dim=64))
    return rows.groupBy("cluster").agg(F.count("*").alias("hit_count"))


@query("topic_rows", """
    SELECT cluster, CASE WHEN cluster % 2 = 0 THEN 'topic ' || cluster
                         ELSE '热点话题 ' || (cluster + 1) END AS topic_name,
           CASE WHEN cluster % 2 = 0 THEN '交通' ELSE '点击查看详情' END AS keywords,
           count(*) AS hit_count,
           string_agg(content, chr(10) ORDER BY message_id) FILTER (WHERE rn <= 3)
             AS representative_queries
    FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY message_id) AS rn
          FROM clustered) GROUP BY cluster""", ("clustered",))
def topic_rows(t):
    c = labelled_messages(t)
    labels = c.groupBy("cluster").agg(F.first(F.lit(0)).alias("x")).select(
        "cluster", F.when(F.col("cluster") % 2 == 0, F.concat(
            F.lit('```json {"topic_name": "topic '), F.col("cluster").cast("string"), F.lit('"} ```')))
        .otherwise("no idea").alias("response"))
    rows = TP.topic_rows(c, labels, ["message_id"])
    return rows.withColumn("keywords", F.array_join("keywords", ",")).withColumn(
        "representative_queries", F.array_join("representative_queries", "\n"))


@query("topic_prompt", """
    SELECT cluster, string_agg(content, chr(10) ORDER BY message_id) AS prompt
    FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY message_id) AS rn
          FROM clustered) WHERE rn <= 10 GROUP BY cluster""", ("clustered",))
def topic_prompt(t):
    return TP.prompts(labelled_messages(t), ["message_id"])


# --- quiz ----------------------------------------------------------------

@query("quiz_sample", """
    WITH d AS (SELECT doc_id FROM (SELECT DISTINCT doc_id FROM chunks)
               ORDER BY md5(doc_id || '#quiz'), doc_id LIMIT 3)
    SELECT doc_id, chunk_idx, text FROM chunks
    WHERE doc_id IN (SELECT doc_id FROM d) AND length(text) > 100
    ORDER BY md5(doc_id || '-' || chunk_idx || '#quiz'), doc_id || '-' || chunk_idx LIMIT 10
    """, ("chunks",))
def quiz_sample(t):
    return Q.sample_input(D.chunks(t))


SHUFFLE = """
    WITH parsed AS (
      SELECT q.id, q.content, q.options, q.correct_answer,
             regexp_replace(list_filter(q.options, lambda o: starts_with(o, q.correct_answer))[1],
                            '^[A-D][.、:： ]+', '') AS right_text
      FROM questions q {where}),
    opts AS (SELECT id, regexp_replace(u.x, '^[A-D][.、:： ]+', '') AS x, u.i AS i
             FROM parsed, UNNEST(options) WITH ORDINALITY AS u(x, i)),
    ord AS (SELECT id, x, row_number() OVER (PARTITION BY id ORDER BY md5(x || '#quiz'), i) AS k
            FROM opts),
    agg AS (SELECT id, string_agg((['A','B','C','D'])[k] || '. ' || x, '|' ORDER BY k) AS options
            FROM ord GROUP BY id),
    ans AS (SELECT p.id, max(o.k) AS k FROM parsed p JOIN ord o ON o.id = p.id AND o.x = p.right_text
            GROUP BY p.id)
    """


@query("quiz_shuffle", SHUFFLE.format(where="") + """
    SELECT a.id, a.options, coalesce((['A','B','C','D'])[n.k], 'A') AS correct_answer,
           n.k IS NOT NULL AS matched FROM agg a LEFT JOIN ans n ON n.id = a.id""", ("questions",))
def quiz_shuffle(t):
    q = D.questions(t).select("id", Q.shuffle_options(F.col("options"), F.col("correct_answer"), "quiz")
                              .alias("s"))
    return q.select("id", F.array_join("s.options", "|").alias("options"), "s.correct_answer",
                    "s.matched")


@query("quiz_build", SHUFFLE.format(where="WHERE id % 8 <> 0") + """
    SELECT a.id, p.content, a.options, coalesce((['A','B','C','D'])[n.k], 'A') AS correct_answer,
           n.k IS NOT NULL AS matched, 'because' AS explanation,
           CAST(3 + CAST('0x' || substr(md5(a.id || '#quiz'), 1, 8) AS BIGINT) % 3 AS INTEGER)
             AS difficulty
    FROM agg a JOIN parsed p ON p.id = a.id LEFT JOIN ans n ON n.id = a.id""", ("questions",))
def quiz_build(t):
    return Q.build_questions(D.raw_questions(t)).withColumn("options", F.array_join("options", "|"))


@query("grade_answers", """
    SELECT a.event_id, a.user_id, a.question_id, a.user_answer,
           upper(a.user_answer) = upper(q.correct_answer) AS is_correct
    FROM answers a JOIN questions q ON a.question_id = q.id""", ("answers", "questions"))
def grade_answers(t):
    return Q.grade(D.answers(t), D.questions(t)).select(
        "event_id", "user_id", "question_id", "user_answer", "is_correct")
