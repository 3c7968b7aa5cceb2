"""Scans, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import jsonx as J
from ..functions import text as X
from ..operators import changes as C
from ..operators import chunking as K
from ..session import checkpoint_dir
from ..sources import io, versions
from . import derived as D
from .catalog import query
from .streams import folder


@query("scan_documents", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def scan_documents(t):
    return t.documents


@query("scan_pruned", """
    SELECT c_custkey AS id, c_name AS username, c_mktsegment AS role FROM customer""")
def scan_pruned(t):
    return t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"),
                             F.col("c_mktsegment").alias("role"))


@query("read_text_fallback", r"""
    SELECT doc_id, doc_id % 2 AS gbk,
           '第' || doc_id || '条 ' || CASE WHEN doc_id % 2 = 1
             THEN regexp_replace(text, '[^\x00-\x7f]', '', 'g') ELSE text END AS text
    FROM documents""")
def read_text_fallback(t):
    """Half of the documents arrive as GBK bytes (reduced to what GBK can hold)."""
    io.allow_gbk(t.spark)
    odd = F.col("doc_id") % 2 == 1
    prefix = F.concat(F.lit("第"), F.col("doc_id").cast("string"), F.lit("条 "))
    ascii_only = F.regexp_replace("text", r"[^\x00-\x7f]", "")
    content = F.when(odd, F.encode(F.concat(prefix, ascii_only), "GBK")).otherwise(
        F.encode(F.concat(prefix, F.col("text")), "UTF-8"))
    files = t.documents.select("doc_id", content.alias("content"))
    return files.select("doc_id", (F.col("doc_id") % 2).alias("gbk"),
                        io.decode_text(F.col("content")).alias("text"))


#: Folders over the text files, and tasks that write them.
FILE_BLOCKS = 256


@query("read_text_files", r"""
    SELECT doc_id // 50 AS file, doc_id // 50 % 2 = 1 AS gbk,
           md5(string_agg(line, chr(10) ORDER BY doc_id) || chr(10)) AS digest
    FROM (SELECT doc_id, '第' || doc_id || '条 ' || CASE WHEN doc_id // 50 % 2 = 1
                   THEN regexp_replace(text, '[^\x00-\x7f]', '', 'g') ELSE text END AS line
          FROM documents WHERE text IS NOT NULL) GROUP BY doc_id // 50""")
def read_text_files(t):
    """Documents stored as text files of 50, every other file in GBK, and read back file by file.

    The folders of the files lie in ``FILE_BLOCKS`` folders. A block is written by one task, moved as one folder when
    the job commits and listed by one task; with all files in one folder these cost a step or a task per file.
    """
    path, file = folder(t, "files"), F.expr("doc_id div 50")
    gbk = file % 2 == 1
    text = F.when(gbk, F.regexp_replace("text", r"[^\x00-\x7f]", "")).otherwise(F.col("text"))
    line = F.concat(F.lit("第"), F.col("doc_id").cast("string"), F.lit("条 "), text)
    raw = F.when(gbk, F.encode(line, "GBK")).otherwise(F.encode(line, "UTF-8"))
    io.allow_gbk(t.spark)
    (t.documents.where("text is not null").select(file.alias("file"), "doc_id", raw.cast("string").alias("value"))
     .withColumn("block", F.pmod(F.xxhash64("file"), F.lit(FILE_BLOCKS)))
     # a fixed number of tasks: files take time to make, whatever their bytes
     .repartition(FILE_BLOCKS, "block").sortWithinPartitions("block", "file", "doc_id")
     .select("block", "file", "value").write.partitionBy("block", "file").text(path))
    number = F.regexp_extract("path", r"file=(\d+)/[^/]*$", 1).cast("bigint")
    read = io.read_text_files(t.spark, path, nested=True).select(number.alias("file"), "text")
    return read.select("file", (F.col("file") % 2 == 1).alias("gbk"), F.md5("text").alias("digest"))


@query("full_refresh", """
    SELECT 0::BIGINT AS version, doc_id, quality::BIGINT AS quality FROM labels WHERE quality = 0
    UNION ALL SELECT 1, doc_id, quality::BIGINT FROM labels""")
def full_refresh(t):
    """A table refreshed twice: a reader of the first version still has it, a new reader has the second."""
    base, rows = folder(t, "refreshed"), t.labels.select("doc_id", F.col("quality").cast("bigint").alias("quality"))
    first = versions.refresh(rows.filter("quality = 0"), base)
    pinned = versions.read(t.spark, base, rows.schema, first)
    second = versions.refresh(rows, base)
    now = versions.read(t.spark, base, rows.schema)
    return (pinned.withColumn("version", F.lit(first).cast("bigint"))
            .unionByName(now.withColumn("version", F.lit(second).cast("bigint"))).select("version", "doc_id", "quality"))


@query("route_by_ext", """
    SELECT id, ext, CASE WHEN ext NOT IN ('pdf','txt','docx','md') THEN 'rejected'
                         WHEN ext IN ('pdf','txt') THEN ext ELSE 'other' END AS route
    FROM (SELECT id, lower(string_split(filename, '.')[-1]) AS ext FROM docs)""", ("docs",))
def route_by_ext(t):
    ext = X.file_extension(F.col("filename"))
    return D.docs(t).select("id", ext.alias("ext"), X.parser_route(ext).alias("route"))


@query("ingest_status", """
    SELECT d.id, d.filename, coalesce(c.n, 0)::BIGINT AS chunk_count,
           CASE WHEN coalesce(c.n, 0) = 0 THEN 'processing' ELSE 'done' END AS status
    FROM docs d LEFT JOIN (
      SELECT doc_id, count(*) AS n FROM chunks WHERE length(text) >= 15 GROUP BY doc_id) c
      ON d.id = c.doc_id""", ("docs", "chunks"))
def ingest_status(t):
    kept = D.chunks(t).filter(F.length("text") >= 15)
    counted = K.chunk_counts(D.docs(t).select("id", "filename"), kept)
    return counted.withColumn("status", F.when(F.col("chunk_count") == 0, "processing")
                              .otherwise("done"))


@query("vector_append", """
    SELECT vec_id AS id, label, len(embedding)::INTEGER AS dim,
           CAST(to_json(list_transform(embedding, lambda x: floor(x::DOUBLE * 1000)::BIGINT)) AS VARCHAR) AS v
    FROM embeddings""")
def vector_append(t):
    """Two appends to a vector table in the shared folder, read back with the declared schema."""
    path = f"{checkpoint_dir(t.spark)}/vectors-{uuid.uuid4().hex}"
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    io.append_vectors(v.filter(F.col("label") < 5), path)
    io.append_vectors(v.filter(F.col("label") >= 5), path)
    stored = t.spark.read.schema("id BIGINT, v ARRAY<FLOAT>, label INT").parquet(path)
    milli = F.transform("v", lambda x: F.floor(x.cast("double") * 1000))
    return stored.select("id", "label", F.size("v").alias("dim"),
                         F.to_json(milli).cast("string").alias("v"))


@query("append_messages", """
    SELECT message_id, session_id, role, content FROM msgs""", ("msgs",))
def append_messages(t):
    path = f"{checkpoint_dir(t.spark)}/messages-{uuid.uuid4().hex}"
    m = D.msgs(t).select("message_id", "session_id", "role", "content")
    io.append_rows(m.filter(F.col("role") == "user"), path)
    io.append_rows(m.filter(F.col("role") != "user"), path)
    return t.spark.read.schema(
        "message_id BIGINT, session_id STRING, role STRING, content STRING").parquet(path)


@query("json_array_roundtrip", """
    SELECT id, CAST(u.i - 1 AS INTEGER) AS pos, u.x AS option
    FROM questions q, UNNEST(q.options) WITH ORDINALITY AS u(x, i)""", ("questions",))
def json_array_roundtrip(t):
    stored = D.questions(t).select("id", F.to_json("options").alias("options"))
    return stored.select("id", F.posexplode(J.string_array(F.col("options"))).alias("pos", "option"))


@query("cache_put", """
    SELECT key, event_id, value FROM (
      SELECT md5(user_id || '|' || event_type) AS key, event_id, value,
             row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) rn
      FROM events) WHERE rn = 1""")
def cache_put(t):
    puts = t.events.select(
        F.md5(F.concat_ws("|", F.col("user_id").cast("string"), "event_type")).alias("key"),
        "event_id", "value", "ts")
    return C.last_change(puts, ["key"], ["ts", "event_id"]).select("key", "event_id", "value")


@query("sse_parse", """
    SELECT stream_id, seq, type, data FROM frames""", ("frames",))
def sse_parse(t):
    """Whole event streams as text, with unreadable and foreign blocks mixed in, parsed back."""
    def block(e):
        return F.concat(F.lit("data: "), F.to_json(e))

    m = D.msgs(t).filter(F.col("role") == "ai")
    pieces = K.fixed_blocks(F.col("content"), 40)
    head = block(F.struct(F.lit("sources").alias("type"),
                          F.concat(F.lit("src "), F.col("session_id")).alias("data")))
    body = F.transform(pieces, lambda x: block(F.struct(F.lit("content").alias("type"),
                                                        x.alias("data"))))
    done = F.when(F.col("message_id") % 6 == 5, F.lit("data: {broken")).otherwise(
        F.lit('data: {"type": "done", "data": ""}'))
    raw = F.concat_ws("\n\n", F.array(head), body, F.array(F.lit(": keep-alive")), F.array(done))
    blocks = m.select(F.col("message_id").cast("string").alias("stream_id"),
                      F.posexplode(F.split(raw, "\n\n")).alias("n", "value"))
    parsed = io.parse_frames(blocks)
    # the keep-alive block sits between content and done
    return parsed.select("stream_id", F.when(F.col("type") == "done", F.col("n") - 1)
                         .otherwise(F.col("n")).cast("bigint").alias("seq"), "type", "data")
