"""Application tables derived from the given tables, in Spark and as oracle CTEs.

Every function takes the whole given table; nothing is sampled or cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.chunking import fixed_blocks, fixed_chunks
from ..session import spread

EPOCH = "2024-01-01 00:00:00"


def ntz(literal: str):
    return F.lit(literal).cast("timestamp_ntz")


def plus(base, days=None, hours=None, minutes=None, seconds=None):
    zero = F.lit(0)
    return base + F.make_dt_interval(days if days is not None else zero,
                                     hours if hours is not None else zero,
                                     minutes if minutes is not None else zero,
                                     seconds if seconds is not None else zero)


def stamp(c):
    """Timestamps leave the queries as text so that both engines print them alike."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# --- conversations -------------------------------------------------------

def sessions(t) -> DataFrame:
    return t.conversations.select(
        F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"),
        (F.col("conv_id") % 30).alias("user_id")).distinct()


def msgs(t) -> DataFrame:
    c = t.conversations.filter(F.col("role") != "system")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"),
        F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"),
        "turn",
        F.when(F.col("role") == "assistant", "ai").otherwise(F.col("role")).alias("role"),
        F.col("text").alias("content"),
        plus(ntz(EPOCH), hours=F.col("conv_id").cast("int"),
             minutes=F.col("turn").cast("int")).alias("created_at"))


def users(t) -> DataFrame:
    return t.customer.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("username"),
        plus(ntz("2023-12-01 00:00:00"), hours=F.col("c_custkey").cast("int")).alias("created_at"),
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal") >= 0).alias("is_active"),
        F.col("c_mktsegment").alias("segment"))


# --- documents -----------------------------------------------------------

def docs(t) -> DataFrame:
    d = t.documents
    ext = F.element_at(F.array(*map(F.lit, ("pdf", "txt", "docx", "md", "exe"))),
                       (F.col("doc_id") % 5 + 1).cast("int"))
    return d.select(
        F.col("doc_id").alias("id"),
        F.concat(F.col("source"), F.lit("_"), (F.col("doc_id") % 400).cast("string"),
                 F.lit("."), F.when(F.col("doc_id") % 2 == 0, F.upper(ext)).otherwise(ext))
        .alias("filename"),
        F.col("text").alias("content"),
        plus(ntz(EPOCH), minutes=F.col("doc_id").cast("int")).alias("upload_time"))


def chunks(t) -> DataFrame:
    return fixed_chunks(t.texts.select("doc_id", "text"))


def pages_of(t) -> DataFrame:
    d = t.texts.select("doc_id", F.posexplode(fixed_blocks(F.col("text"), 500))
                           .alias("page_no", "text"))
    return d


def md_text(t) -> DataFrame:
    """Documents as Markdown: some lines become headings of level 1 to 3, some indented, some of them in fences."""
    line = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.when(i % 11 == 2, F.lit("```")).when(i % 13 == 6, F.lit("~~~"))
        .when(i % 7 == 0, F.concat(F.lit("# "), x))
        .when(i % 14 == 3, F.concat(F.lit("  ## "), x))
        .when(i % 7 == 3, F.concat(F.lit("## "), x))
        .when(i % 7 == 5, F.concat(F.lit("### "), x))
        .otherwise(x))
    return t.texts.select("doc_id", F.array_join(line, "\n").alias("text"))


def md_lines(t) -> DataFrame:
    return md_text(t).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


# --- retrieval -----------------------------------------------------------

def queries_txt(t) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("qid"), "text")


def queries_both(t) -> DataFrame:
    """Questions with text and vector."""
    e = t.embeddings.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v"))
    return queries_txt(t).join(e, "qid")


def doc_vectors(t) -> DataFrame:
    """Every document with a vector; vectors repeat when there are more documents."""
    n = t.embeddings.select(F.count("*").alias("n")).scalar()
    e = t.embeddings.select("vec_id", F.col("embedding").alias("v"))
    d = t.texts.select(F.col("doc_id").alias("id"), "text",
                           (F.col("doc_id") % n).alias("vec_id"))
    return d.join(e, "vec_id").select("id", "text", "v")


def cache_entries(t) -> DataFrame:
    """Every vector is cached, those of the upper labels turned around, so that some lookups miss."""
    v = F.when(F.col("label") < 5, F.col("embedding")).otherwise(F.reverse("embedding"))
    return t.embeddings.select(
        F.md5(F.col("vec_id").cast("string")).alias("key"), v.alias("v"),
        F.concat(F.lit("answer "), F.col("vec_id").cast("string")).alias("answer"))


# --- graph ---------------------------------------------------------------

def raw_triples(t) -> DataFrame:
    """Model responses: free text around a fenced JSON array of one triple."""
    ident = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    relation = (F.when(F.col("l_returnflag") == "A", "according_to")
                .when(F.col("l_returnflag") == "R", "results_in").otherwise("applies_to"))
    items = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                              "l_returnflag")
    joined = (spread(items, "l_orderkey")
              .join(t.part.select("p_partkey", "p_name", "p_type"),
                    F.col("l_partkey") == F.col("p_partkey"))
              .join(t.supplier.select("s_suppkey", "s_name"),
                    F.col("l_suppkey") == F.col("s_suppkey")))
    body = F.concat(
        F.lit('Here it is:\n```json\n[{"s": "'), F.col("p_name"),
        F.lit('", "cat_s": "'), F.col("p_type"), F.lit('", "r": "'), relation,
        F.lit('", "t": "'), F.col("s_name"), F.lit('"'),
        F.when(ident % 10 == 3, F.lit("")).otherwise(F.lit(', "cat_t": "BASIS"')),
        F.lit("}]\n```"))
    return joined.select(
        ident.alias("id"),
        F.concat(F.col("p_name"), F.lit(" is supplied by "), F.col("s_name")).alias("source_text"),
        F.when(ident % 10 == 1, F.lit("no triple found, sorry")).otherwise(body).alias("response"))


# --- quiz ----------------------------------------------------------------

def questions(t) -> DataFrame:
    p = t.part
    return p.select(
        F.col("p_partkey").alias("id"),
        F.concat(F.lit("Which one fits item "), F.col("p_partkey").cast("string"), F.lit("?"))
        .alias("content"),
        F.array(F.concat(F.lit("A. "), F.col("p_name")), F.concat(F.lit("B. "), F.col("p_brand")),
                F.concat(F.lit("C. "), F.col("p_type")),
                F.concat(F.lit("D. size "), F.col("p_size").cast("string"))).alias("options"),
        letter(F.col("p_partkey")).alias("correct_answer"))


def letter(c):
    return F.element_at(F.array(*map(F.lit, "ABCD")), (c % 4 + 1).cast("int"))


def raw_questions(t) -> DataFrame:
    q = questions(t)
    obj = F.to_json(F.struct("content", "options", "correct_answer",
                             F.lit("because").alias("explanation")))
    return q.select("id", F.when(F.col("id") % 8 == 0, F.lit("I cannot do that {"))
                    .otherwise(F.concat(F.lit("Sure! "), obj, F.lit(" Done."))).alias("response"))


def answers(t) -> DataFrame:
    """Answer log: one row per event."""
    n = t.part.select(F.count("*").alias("n")).scalar()
    a = letter(F.col("event_id"))
    return t.events.select(
        "user_id", (F.col("event_id") % n).alias("question_id"),
        F.when(F.col("event_id") % 2 == 1, F.lower(a)).otherwise(a).alias("user_answer"),
        "event_id", "ts")


# --- configuration, feedback, frames ------------------------------------

def configs(t) -> DataFrame:
    return t.supplier.select(
        F.col("s_suppkey").alias("id"),
        F.concat(F.lit("type_"), F.col("s_nationkey").cast("string")).alias("config_type"),
        F.col("s_name").alias("model_name"),
        (F.col("s_acctbal") > 5000).alias("is_active"))


def feedback(t) -> DataFrame:
    """Ratings of the answers of a conversation: every label rates one, numbered round and round."""
    m = msgs(t).filter(F.col("role") == "ai").select("message_id", "session_id")
    n = t.conversations.agg(F.max("conv_id") + 1).scalar()
    f = (t.labels.withColumn("conv_id", F.col("doc_id") % n)
         .select(F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"),
                 "conv_id", "doc_id", (F.col("quality") == 1).alias("is_helpful")))
    return m.join(f, "session_id").select(
        "message_id",
        F.when(F.col("doc_id") % 5 == 4, (F.col("conv_id") + 1) % 30)
        .otherwise(F.col("conv_id") % 30).alias("user_id"),
        "is_helpful",
        F.concat(F.lit("note "), F.col("doc_id").cast("string")).alias("note"),
        F.col("doc_id").alias("version"))


def frames(t) -> DataFrame:
    """Answer streams: a ``sources`` row, ``content`` rows of 40 characters, ``done`` at the end."""
    m = msgs(t).filter(F.col("role") == "ai")
    pieces = fixed_blocks(F.col("content"), 40)
    n = F.size(pieces)
    events = F.concat(
        F.array(F.struct(F.lit(0).cast("bigint").alias("seq"), F.lit("sources").alias("type"),
                         F.concat(F.lit("src "), F.col("session_id")).alias("data"))),
        F.transform(pieces, lambda x, i: F.struct(
            (i + 1).cast("bigint").alias("seq"), F.lit("content").alias("type"),
            x.alias("data"))),
        F.when(F.col("message_id") % 6 == 5, F.array().cast(
            "array<struct<seq:bigint,type:string,data:string>>"))
        .otherwise(F.array(F.struct((n + 1).cast("bigint").alias("seq"),
                                    F.lit("done").alias("type"), F.lit("").alias("data")))))
    return (m.select(F.col("message_id").cast("string").alias("stream_id"),
                     F.explode(events).alias("e"))
            .select("stream_id", "e.seq", "e.type", "e.data"))


def prefs(t) -> DataFrame:
    return t.customer.select(
        F.col("c_custkey").alias("user_id"),
        F.when(F.col("c_custkey") % 2 == 0, F.create_map(
            F.lit("llm_model"),
            F.when(F.col("c_custkey") % 4 == 0, F.col("c_mktsegment")).otherwise(F.lit(""))))
        .alias("ai_preferences"))


# --- the same tables as DuckDB CTEs --------------------------------------

_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "sessions": ((), """
        SELECT DISTINCT 's' || conv_id AS session_id, conv_id % 30 AS user_id FROM conversations"""),
    "msgs": ((), """
        SELECT conv_id * 1000 + turn AS message_id, 's' || conv_id AS session_id, turn,
               CASE WHEN role = 'assistant' THEN 'ai' ELSE role END AS role, text AS content,
               TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) + to_minutes(turn) AS created_at
        FROM conversations WHERE role <> 'system'"""),
    "users": ((), """
        SELECT c_custkey AS id, c_name AS username,
               TIMESTAMP '2023-12-01 00:00:00' + to_hours(c_custkey) AS created_at,
               CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal >= 0 END AS is_active,
               c_mktsegment AS segment
        FROM customer"""),
    "docs": ((), """
        SELECT doc_id AS id,
               source || '_' || (doc_id % 400) || '.' ||
               CASE WHEN doc_id % 2 = 0
                    THEN upper((['pdf','txt','docx','md','exe'])[doc_id % 5 + 1])
                    ELSE (['pdf','txt','docx','md','exe'])[doc_id % 5 + 1] END AS filename,
               text AS content,
               TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS upload_time
        FROM documents"""),
    "chunks": ((), """
        SELECT doc_id, CAST(u.s // 1000 AS INTEGER) AS chunk_idx,
               substr(text, u.s + 1, 1200) AS text
        FROM documents, UNNEST(range(0, greatest(length(text) - 200, 1), 1000)) AS u(s)
        WHERE length(text) > 0"""),
    "pages_of": ((), """
        SELECT doc_id, CAST(u.s // 500 AS INTEGER) AS page_no, substr(text, u.s + 1, 500) AS text
        FROM documents, UNNEST(range(0, length(text), 500)) AS u(s)"""),
    "md_lines": ((), r"""
        SELECT doc_id, CAST(u.i - 1 AS INTEGER) AS pos, ls[u.i] AS line,
               CASE WHEN list_reduce(list_prepend(0, kinds[:u.i - 1]), lambda s, k: CASE
                      WHEN s = 0 THEN CASE k WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 0 END
                      WHEN s = 1 THEN CASE WHEN k IN (1, 2) THEN 0 ELSE 1 END
                      ELSE CASE k WHEN 3 THEN 0 ELSE 2 END END) = 0
                    THEN length(regexp_extract(ls[u.i], '^[ \t]*(#{1,4}) ', 1)) ELSE 0 END AS lv,
               trim(regexp_extract(ls[u.i], '^[ \t]*#{1,4} (.*)$', 1)) AS title
        FROM (SELECT doc_id, ls, list_transform(ls, lambda x: CASE
                       WHEN regexp_matches(x, '^[ \t]*~~~') THEN 3 WHEN regexp_matches(x, '^[ \t]*```.*```') THEN 2
                       WHEN regexp_matches(x, '^[ \t]*```') THEN 1 ELSE 0 END) AS kinds
              FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: CASE
                             WHEN (i - 1) % 11 = 2 THEN '```' WHEN (i - 1) % 13 = 6 THEN '~~~'
                             WHEN (i - 1) % 7 = 0 THEN '# ' || x WHEN (i - 1) % 14 = 3 THEN '  ## ' || x
                             WHEN (i - 1) % 7 = 3 THEN '## ' || x WHEN (i - 1) % 7 = 5 THEN '### ' || x
                             ELSE x END) AS ls FROM documents)) d,
             UNNEST(range(1, len(ls) + 1)) AS u(i)"""),
    "queries_txt": ((), "SELECT item_id AS qid, text FROM benchmark"),
    "queries_both": ((), """
        SELECT b.item_id AS qid, b.text, e.embedding AS v
        FROM benchmark b JOIN embeddings e ON b.item_id = e.vec_id"""),
    "doc_vectors": ((), """
        SELECT d.doc_id AS id, d.text, e.embedding AS v
        FROM documents d JOIN embeddings e
          ON e.vec_id = d.doc_id % (SELECT count(*) FROM embeddings)"""),
    "cache_entries": ((), """
        SELECT md5(CAST(vec_id AS VARCHAR)) AS key,
               CASE WHEN label < 5 THEN embedding ELSE list_reverse(embedding) END AS v,
               'answer ' || vec_id AS answer
        FROM embeddings"""),
    "raw_triples": ((), """
        SELECT id, p_name || ' is supplied by ' || s_name AS source_text,
               CASE WHEN id % 10 = 1 THEN 'no triple found, sorry'
               ELSE 'Here it is:' || chr(10) || '```json' || chr(10) || '[{"s": "' || p_name ||
                    '", "cat_s": "' || p_type || '", "r": "' ||
                    CASE l_returnflag WHEN 'A' THEN 'according_to' WHEN 'R' THEN 'results_in'
                         ELSE 'applies_to' END ||
                    '", "t": "' || s_name || '"' ||
                    CASE WHEN id % 10 = 3 THEN '' ELSE ', "cat_t": "BASIS"' END ||
                    '}]' || chr(10) || '```' END AS response
        FROM (SELECT l_orderkey * 10 + l_linenumber AS id, * FROM lineitem) l
        JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"""),
    "triples": (("raw_triples",), """
        SELECT id, x->>'$.s' AS s, x->>'$.cat_s' AS cat_s, x->>'$.r' AS r, x->>'$.t' AS t,
               x->>'$.cat_t' AS cat_t
        FROM (SELECT id, CAST(regexp_extract(
                  regexp_replace(response, '```(json)?', '', 'g'), '\\[.*\\]', 0, 's')
                  AS JSON) AS j
              FROM raw_triples
              WHERE length(source_text) >= 20
                AND regexp_extract(regexp_replace(response, '```(json)?', '', 'g'),
                                   '\\[.*\\]', 0, 's') <> '') q,
             UNNEST(CAST(j AS JSON[])) AS u(x)
        WHERE (x->>'$.s') IS NOT NULL AND (x->>'$.cat_s') IS NOT NULL AND (x->>'$.r') IS NOT NULL
          AND (x->>'$.t') IS NOT NULL AND (x->>'$.cat_t') IS NOT NULL"""),
    "nodes": (("triples",), """
        SELECT md5(name) AS node_id, name, category FROM (
          SELECT name, category, row_number() OVER (PARTITION BY name ORDER BY id, side) AS rn
          FROM (SELECT id, 0 AS side, s AS name, cat_s AS category FROM triples
                UNION ALL SELECT id, 1, t, cat_t FROM triples)) WHERE rn = 1"""),
    "edges": (("triples",), """
        SELECT DISTINCT md5(s) AS source_id, md5(t) AS target_id, r AS relation FROM triples"""),
    "questions": ((), """
        SELECT p_partkey AS id, 'Which one fits item ' || p_partkey || '?' AS content,
               ['A. ' || p_name, 'B. ' || p_brand, 'C. ' || p_type, 'D. size ' || p_size] AS options,
               (['A','B','C','D'])[p_partkey % 4 + 1] AS correct_answer
        FROM part"""),
    "answers": ((), """
        SELECT user_id, event_id % (SELECT count(*) FROM part) AS question_id,
               CASE WHEN event_id % 2 = 1 THEN lower((['A','B','C','D'])[event_id % 4 + 1])
                    ELSE (['A','B','C','D'])[event_id % 4 + 1] END AS user_answer, event_id, ts
        FROM events"""),
    "configs": ((), """
        SELECT s_suppkey AS id, 'type_' || s_nationkey AS config_type, s_name AS model_name,
               s_acctbal > 5000 AS is_active FROM supplier"""),
    "feedback": (("msgs",), """
        SELECT m.message_id,
               CASE WHEN l.doc_id % 5 = 4 THEN (l.conv_id + 1) % 30 ELSE l.conv_id % 30 END AS user_id,
               l.quality = 1 AS is_helpful, 'note ' || l.doc_id AS note, l.doc_id AS version
        FROM msgs m JOIN (
          SELECT *, doc_id % (SELECT max(conv_id) + 1 FROM conversations) AS conv_id FROM labels) l
          ON m.session_id = 's' || l.conv_id WHERE m.role = 'ai'"""),
    "frames": (("msgs",), """
        SELECT CAST(message_id AS VARCHAR) AS stream_id, 0::BIGINT AS seq, 'sources' AS type,
               'src ' || session_id AS data FROM msgs WHERE role = 'ai'
        UNION ALL
        SELECT CAST(message_id AS VARCHAR), CAST(u.s // 40 + 1 AS BIGINT), 'content',
               substr(content, u.s + 1, 40)
        FROM msgs, UNNEST(range(0, length(content), 40)) AS u(s) WHERE role = 'ai'
        UNION ALL
        SELECT CAST(message_id AS VARCHAR), CAST((length(content) + 39) // 40 + 1 AS BIGINT),
               'done', '' FROM msgs WHERE role = 'ai' AND message_id % 6 <> 5"""),
    "prefs": ((), """
        SELECT c_custkey AS user_id,
               CASE WHEN c_custkey % 2 = 0 THEN
                 CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment ELSE '' END END AS llm_model
        FROM customer"""),
}


def _collect(names, seen) -> None:
    for name in names:
        if name not in seen:
            deps, _ = _CTES[name]
            _collect(deps, seen)
            seen.append(name)


def with_ctes(names, body: str) -> str:
    """Prefix ``body`` with the named CTEs and what they depend on."""
    order: list[str] = []
    _collect(names, order)
    body = body.strip()
    if not order:
        return body
    heads = ",\n".join(f"{n} AS ({_CTES[n][1]}\n)" for n in order)
    if body.upper().startswith("WITH "):
        return f"WITH {heads},\n{body[5:]}"
    return f"WITH {heads}\n{body}"


def add_ctes(**ctes: tuple[tuple[str, ...], str]) -> None:
    _CTES.update(ctes)
