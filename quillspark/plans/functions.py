"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import jsonx as J
from ..functions import numeric as N
from ..functions import text as X
from ..functions import vectors as V
from ..operators import topics as TP
from ..sources.schemas import TRIPLE_JSON
from . import derived as D
from .catalog import query

CONTROL_SQL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
SPACE_SQL = (r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
             r"\x{205f}\x{3000}]")


def clean_sql(x: str) -> str:
    y = f"regexp_replace({x}, '{CONTROL_SQL}', '', 'g')"
    y = f"regexp_replace({y}, '{SPACE_SQL}+', ' ', 'g')"
    y = rf"regexp_replace({y}, '(\p{{Nd}}) ([a-zA-Z])', '\1\2', 'g')"
    y = rf"regexp_replace({y}, '([a-zA-Z]) (/)', '\1\2', 'g')"
    y = rf"regexp_replace({y}, '(/) ([a-zA-Z])', '\1\2', 'g')"
    return f"trim({y})"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g')"


def cat(*parts):
    """Concatenate columns and literal text."""
    return F.concat(*[F.col(p[1:]).cast("string") if p.startswith("$") else F.lit(p)
                      for p in parts])


@query("strict_clean", "SELECT doc_id, " + clean_sql(
    "' 60 km / h' || chr(12288) || chr(160) || chr(9) || chr(7) || doc_id || ' kg / m ' || text "
    "|| chr(8195)") + " AS text FROM documents")
def strict_clean(t):
    dirty = cat(" 60 km / h　 \t\u0007", "$doc_id", " kg / m ", "$text", " ")
    return t.texts.select("doc_id", X.strict_clean(dirty).alias("text"))


@query("join_broken_lines", r"""
    SELECT doc_id, regexp_replace('句子没有' || chr(10) || '结束。' || chr(10) || '下一句' || chr(10)
           || '# 标题' || chr(10) || text,
           '([^.。：:；;!！?？>])' || chr(10) || '+([^' || chr(10) || '#*-])', '\1\2', 'g') AS text
    FROM documents""")
def join_broken_lines(t):
    raw = cat("句子没有\n结束。\n下一句\n# 标题\n", "$text")
    return t.texts.select("doc_id", X.join_broken_lines(raw).alias("text"))


@query("clause_extract", r"""
    SELECT doc_id, coalesce(nullif(regexp_extract(CASE doc_id % 3
             WHEN 0 THEN text || ' 依据第' || doc_id || '条规定'
             WHEN 1 THEN text || ' 依据第九十一条规定' ELSE text END,
           '第[一-龥\p{Nd}]+条', 0), ''), '明细条款') AS clause FROM documents""")
def clause_extract(t):
    m = F.col("doc_id") % 3
    text = (F.when(m == 0, cat("$text", " 依据第", "$doc_id", "条规定"))
            .when(m == 1, cat("$text", " 依据第九十一条规定")).otherwise(F.col("text")))
    return t.documents.select("doc_id", X.clause_number(text).alias("clause"))


@query("json_extract", r"""
    SELECT id, regexp_extract(regexp_replace(response, '```(json)?', '', 'g'), '\[.*\]', 0, 's')
             AS arr,
           coalesce(regexp_extract(response, '\{.*\}', 0, 's'), '') AS obj
    FROM raw_triples""", ("raw_triples",))
def json_extract(t):
    r = D.raw_triples(t)
    return r.select("id", J.embedded_array(F.col("response")).alias("arr"),
                    J.embedded_object(F.col("response")).alias("obj"))


@query("markup_scrub", r"""
    SELECT * FROM (
      SELECT message_id, regexp_replace(regexp_replace(
               CASE WHEN message_id % 3 = 0 THEN '<|DSML|x></dsml>'
                    ELSE '<|DSML|x>' || content || '</|dsml|>' END,
               '<\|?DSML\|?.*?>', '', 'gi'), '</\|?DSML\|?.*?>', '', 'gi') AS content FROM msgs)
    WHERE content <> ''""", ("msgs",))
def markup_scrub(t):
    raw = F.when(F.col("message_id") % 3 == 0, "<|DSML|x></dsml>").otherwise(
        cat("<|DSML|x>", "$content", "</|dsml|>"))
    m = D.msgs(t).select("message_id", X.scrub_markup(raw).alias("content"))
    return m.filter(X.strip(F.col("content")) != "")


@query("option_strip", """
    SELECT id, array_to_string(list_transform(options, lambda o:
             regexp_replace(o, '^[A-D][.、:：""" + SPACE_SQL[1:-1] + """]+', '')), '|') AS options
    FROM (SELECT id, list_concat(options, ['B、' || content, 'C：' || content, 'D ' || content,
                                           'A' || content]) AS options FROM questions)
    """, ("questions",))
def option_strip(t):
    extra = F.array(cat("B、", "$content"), cat("C：", "$content"), cat("D ", "$content"),
                    cat("A", "$content"))
    q = D.questions(t).withColumn("options", F.concat("options", extra))
    return q.select("id", F.array_join(F.transform("options", X.strip_option_prefix), "|")
                    .alias("options"))


@query("plain_text", r"""
    SELECT message_id, regexp_replace(regexp_replace(
             '## **' || content || '** `x` > [依据' || turn || '] [资料2]', '[#*`>]', '', 'g'),
             '\[(依据|资料)\p{Nd}+\]', '', 'g') AS content FROM msgs""", ("msgs",))
def plain_text(t):
    raw = cat("## **", "$content", "** `x` > [依据", "$turn", "] [资料2]")
    return D.msgs(t).select("message_id", X.plain_speech(raw).alias("content"))


@query("nearby_parse", r"""
    SELECT c_custkey, CASE WHEN hit THEN regexp_extract(q, '(.+?)(附近|周边)(的)?(.+)', 1) ELSE q END
             AS landmark,
           CASE WHEN hit THEN regexp_extract(q, '(.+?)(附近|周边)(的)?(.+)', 4) ELSE q END AS category
    FROM (SELECT *, regexp_matches(q, '(.+?)(附近|周边)(的)?(.+)') AS hit FROM (
      SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name || '附近的' || c_mktsegment
                                           WHEN 1 THEN c_name || '周边' || c_mktsegment
                                           ELSE c_name END AS q FROM customer))""")
def nearby_parse(t):
    m = F.col("c_custkey") % 3
    q = (F.when(m == 0, cat("$c_name", "附近的", "$c_mktsegment"))
         .when(m == 1, cat("$c_name", "周边", "$c_mktsegment")).otherwise(F.col("c_name")))
    return t.customer.select("c_custkey", q.alias("q")).select(
        "c_custkey", X.nearby_parts(F.col("q")).alias("p")).select("c_custkey", "p.*")


BUCKETS = [(["tion"], "rain"), (["ent", "eau"], "cloud"), (["sch"], "snow")]


@query("keyword_bucket", """
    SELECT doc_id, CASE WHEN contains(text, 'tion') THEN 'rain'
                        WHEN contains(text, 'ent') OR contains(text, 'eau') THEN 'cloud'
                        WHEN contains(text, 'sch') THEN 'snow' ELSE 'sun' END AS bucket,
           CASE doc_id % 4 WHEN 0 THEN 'rain' WHEN 1 THEN 'cloud' WHEN 2 THEN 'snow' ELSE 'sun' END
             AS live,
           CASE doc_id % 4 WHEN 0 THEN 'rain' WHEN 3 THEN 'sun' ELSE 'cloud' END AS forecast
    FROM documents""")
def keyword_bucket(t):
    m = F.col("doc_id") % 4
    word = F.when(m == 0, "雨夹雪").when(m == 1, "多云").when(m == 2, "雪").otherwise("晴")
    return t.documents.select(
        "doc_id", X.keyword_bucket(F.col("text"), BUCKETS, "sun").alias("bucket"),
        X.weather_icon(word).alias("live"), X.forecast_icon(word).alias("forecast"))


@query("rewrite_trim", "SELECT message_id, replace(" + strip_sql(
    "chr(12288) || '\"' || content || '\" '") + ", '\"', '') AS q FROM msgs", ("msgs",))
def rewrite_trim(t):
    return D.msgs(t).select("message_id", X.rewritten_query(cat("　\"", "$content", "\" "))
                            .alias("q"))


@query("dedup_by_filename", """
    SELECT filename, min(id) AS id FROM docs GROUP BY filename""", ("docs",))
def dedup_by_filename(t):
    return D.docs(t).groupBy("filename").agg(F.min("id").alias("id"))


@query("dedup_by_md5", """
    SELECT md5(content) AS h, min(id) AS id, count(*) AS copies FROM docs GROUP BY h""", ("docs",))
def dedup_by_md5(t):
    return (D.docs(t).groupBy(F.md5("content").alias("h"))
            .agg(F.min("id").alias("id"), F.count("*").alias("copies")))


@query("citation_resolve", """
    SELECT message_id, CAST(ord AS INTEGER) AS ord, n, coalesce(
             CASE WHEN n BETWEEN 1 AND 3 THEN src[n] END, 'unresolved') AS source
    FROM (SELECT message_id, ['s1 ' || session_id, 's2 ' || session_id, 's3 ' || session_id] AS src,
                 content || ' [资料1][资料' || (turn + 2) || ']' AS answer
          FROM msgs WHERE role = 'ai') m,
         UNNEST(CAST(regexp_extract_all(answer, '\\[资料(\\p{Nd}+)\\]', 1) AS INTEGER[]))
           WITH ORDINALITY AS u(n, ord)""", ("msgs",))
def citation_resolve(t):
    m = D.msgs(t).filter(F.col("role") == "ai").select(
        "message_id",
        F.array(cat("s1 ", "$session_id"), cat("s2 ", "$session_id"), cat("s3 ", "$session_id"))
        .alias("src"),
        F.concat("content", F.lit(" [资料1][资料"), (F.col("turn") + 2).cast("string"), F.lit("]"))
        .alias("answer"))
    c = m.select("message_id", "src", F.posexplode(X.cited_numbers(F.col("answer"))).alias("ord", "n"))
    return c.select("message_id", (F.col("ord") + 1).alias("ord"), "n",
                    F.coalesce(F.when(F.col("n") >= 1, F.get("src", F.col("n") - 1)),
                               F.lit("unresolved")).alias("source"))


TOKENS = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}]+')"


@query("tokenize", "SELECT doc_id, len(ts)::BIGINT AS n, array_to_string(ts, ' ') AS tokens "
       "FROM (SELECT doc_id, " + TOKENS.format("text") + " AS ts FROM documents)")
def tokenize(t):
    d = t.texts.select("doc_id", X.tokenize(F.col("text")).alias("ts"))
    return d.select("doc_id", F.size("ts").cast("bigint").alias("n"),
                    F.array_join("ts", " ").alias("tokens"))


@query("short_date", """
    SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%m-%d') AS label FROM events""")
def short_date(t):
    return t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"),
                           F.date_format("ts", "MM-dd").alias("label"))


@query("token_estimate", """
    SELECT message_id, floor(length(content) * 1.5)::BIGINT AS tokens FROM msgs""", ("msgs",))
def token_estimate(t):
    return D.msgs(t).select("message_id", N.token_estimate(F.col("content")).alias("tokens"))


@query("unit_convert", """
    SELECT l_orderkey, l_linenumber, round_even(CAST(CAST(l_extendedprice AS BIGINT)::DOUBLE
             / 1000.0::DOUBLE AS DECIMAL(38,6)), 2)::DOUBLE AS km,
           round_even(CAST(CAST(l_quantity AS BIGINT)::DOUBLE * 30 / 60.0::DOUBLE
             AS DECIMAL(38,6)), 0)::BIGINT AS minutes
    FROM (SELECT l_orderkey, l_linenumber, floor(l_extendedprice) AS l_extendedprice, l_quantity
          FROM lineitem)""")
def unit_convert(t):
    m = F.floor("l_extendedprice").cast("double")
    s = F.col("l_quantity").cast("bigint").cast("double") * 30
    return t.lineitem.select("l_orderkey", "l_linenumber", N.metres_to_km(m).alias("km"),
                             N.seconds_to_minutes(s).alias("minutes"))


@query("cosine_pairs", """
    SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(
             CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_pairs(t):
    e = t.embeddings.select("vec_id", V.as_double(F.col("embedding")).alias("v"))
    b = e.select(F.col("vec_id").alias("b"), F.col("v").alias("w"))
    return e.join(b, F.col("b") == F.col("vec_id") + 1).select(
        F.col("vec_id").alias("a"), "b", F.round(V.cosine(F.col("v"), F.col("w")), 6)
        .alias("similarity"))


@query("array_tail", """
    SELECT doc_id, array_to_string(ls[greatest(len(ls) - 7, 1):], '|') AS last8,
           array_to_string(ls[1:3], '|') AS first3, array_to_string(ls[2:4], '|') AS next3
    FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)""")
def array_tail(t):
    d = t.documents.select("doc_id", F.split("text", "\n").alias("ls"))
    return d.select("doc_id", F.array_join(A.tail(F.col("ls"), 8), "|").alias("last8"),
                    F.array_join(A.head(F.col("ls"), 3), "|").alias("first3"),
                    F.array_join(F.slice("ls", 2, 3), "|").alias("next3"))


@query("topic_label_parse", """
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'about ' || source WHEN 1 THEN '未分类主题'
                        ELSE '热点话题 ' || (doc_id + 1) END AS topic_name,
           CASE doc_id % 4 WHEN 0 THEN lang || ',' || source WHEN 1 THEN '交通'
                ELSE '点击查看详情' END AS keywords
    FROM documents""")
def topic_label_parse(t):
    m = F.col("doc_id") % 4
    full = F.to_json(F.struct(cat("about ", "$source").alias("topic_name"),
                              F.array("lang", "source").alias("keywords")))
    response = (F.when(m == 0, F.concat(F.lit("Here: "), full)).when(m == 1, F.lit('{"x": 1}'))
                .when(m == 2, F.lit("{broken: ]}")).otherwise(F.lit("none")))
    d = t.documents.select("doc_id", "lang", "source", response.alias("r"))
    return d.select("doc_id", TP.parse_label(F.col("r"), F.col("doc_id")).alias("l")).select(
        "doc_id", "l.topic_name", F.array_join("l.keywords", ",").alias("keywords"))


@query("triples_explode", r"""
    SELECT message_id, CAST(u.i - 1 AS INTEGER) AS pos, u.x->>'$.s' AS s, u.x->>'$.t' AS t
    FROM (SELECT message_id, CAST(to_json(list_transform(
            string_split(content, ' '), lambda w: {'s': w, 'cat_s': role, 'r': 'applies_to',
                                                       't': session_id, 'cat_t': 'LIMIT'}))
            AS JSON[]) AS js FROM msgs) m, UNNEST(js) WITH ORDINALITY AS u(x, i)""", ("msgs",))
def triples_explode(t):
    objs = F.transform(F.split("content", " "), lambda w: F.struct(
        w.alias("s"), F.col("role").alias("cat_s"), F.lit("applies_to").alias("r"),
        F.col("session_id").alias("t"), F.lit("LIMIT").alias("cat_t")))
    j = D.msgs(t).select("message_id", F.to_json(objs).alias("j"))
    return (j.select("message_id", F.posexplode(F.from_json("j", TRIPLE_JSON)).alias("pos", "x"))
            .select("message_id", "pos", "x.s", "x.t"))


@query("tool_label", """
    SELECT event_id, CASE event_type WHEN 'click' THEN 'route' WHEN 'view' THEN 'nearby'
                          WHEN 'error' THEN 'weather' ELSE '' END AS label FROM events""")
def tool_label(t):
    e = F.col("event_type")
    tool = (F.when(e == "click", "agent_get_route").when(e == "view", "agent_search_nearby")
            .when(e == "error", "agent_get_weather").otherwise(e))
    return t.events.select("event_id", X.tool_label(tool).alias("label"))
