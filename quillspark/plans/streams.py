"""Streaming forms over the given tables: a table is replayed as a file stream and drained.

Every query runs one ``availableNow`` stream to its end and returns what it wrote.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunking as K
from ..operators.dense import Embedder
from ..session import checkpoint_dir
from ..streaming import cachelog, counters, ingest, keyed, sinks
from . import derived as D
from .catalog import query
from .knowledge import CHUNK_BUILD, CLAUSED
from .sessions import GAPS

#: The oracle's chunks of a plain document, before the even ones are given a clause.
CHUNKED = CHUNK_BUILD.replace(CLAUSED, "text")


def folder(t, name: str) -> str:
    return f"{checkpoint_dir(t.spark)}/{t.spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def replay(t, df: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """The rows of a table, stored in the shared folder, as a stream of its files."""
    path = folder(t, "replayed")
    df.write.parquet(path)
    stream = t.spark.readStream.schema(df.schema)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    return stream.parquet(path)


def drain(t, stream: DataFrame, mode: str) -> DataFrame:
    """All rows that the stream emits (``append``, ``update``), or its last full result (``complete``)."""
    out = folder(t, "drained")

    def sink(batch: DataFrame, batch_id: int) -> None:
        sinks.write_batch(batch, out, 0 if mode == "complete" else batch_id)

    (stream.writeStream.foreachBatch(sink).outputMode(mode)
     .option("checkpointLocation", folder(t, "progress")).trigger(availableNow=True)
     .start().awaitTermination())
    # an input without rows may end without a batch
    empty = t.spark.createDataFrame([], stream.schema)
    sinks.write_batch(empty, out, -1)
    return sinks.read_batches(t.spark, out, stream.schema)


@query("stream_counters", """
    SELECT count(*) AS queries, count(*) FILTER (WHERE event_type = 'view') AS hits FROM events""")
def stream_counters(t):
    events = replay(t, t.events.select("event_type"))
    return drain(t, counters.running_counters(events, F.col("event_type") == "view"), "complete")


@query("stream_counts_by", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_counts_by(t):
    return drain(t, counters.counts_by(replay(t, t.events.select("event_type")), "event_type"), "complete")


@query("stream_daily_tokens", """
    SELECT strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS day, role,
           sum(floor(length(content) * 1.5))::BIGINT AS tokens
    FROM msgs GROUP BY CAST(created_at AS DATE), role""", ("msgs",))
def stream_daily_tokens(t):
    """Updated sums per day and role; a sum only grows, so the largest is the last."""
    days = drain(t, counters.daily_tokens(replay(t, D.msgs(t)), "400 days"), "update")
    return days.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"), "role").agg(
        F.max("tokens").cast("bigint").alias("tokens"))


@query("stream_unique_uploads", "SELECT DISTINCT filename FROM docs", ("docs",))
def stream_unique_uploads(t):
    return drain(t, counters.drop_repeated_uploads(replay(t, D.docs(t).select("filename"))), "append")


@query("stream_assemble_answer", """
    SELECT stream_id, coalesce(string_agg(data, '' ORDER BY seq) FILTER (WHERE type = 'content'), '')
             AS content,
           max_by(data, seq) FILTER (WHERE type = 'sources') AS sources
    FROM frames GROUP BY stream_id HAVING count(*) FILTER (WHERE type = 'done') > 0""", ("frames",))
def stream_assemble_answer(t):
    minute = F.timestamp_seconds(F.col("stream_id").cast("bigint") * 60 + F.col("seq"))
    return drain(t, keyed.assemble_answers(replay(t, D.frames(t).withColumn("ts", minute)), lateness="400000 days"),
                 "append")


@query("stream_history_size", GAPS + """
    SELECT session_id, count(*) AS size FROM (
      SELECT CAST(user_id AS VARCHAR) AS session_id, sid, max(sid) OVER (PARTITION BY user_id) AS top,
             row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM s)
    WHERE sid = top AND back <= 16 GROUP BY session_id""")
def stream_history_size(t):
    """Messages in the live history of every session at the end of the stream."""
    e = t.events.select(F.col("user_id").cast("string").alias("session_id"),
                        F.col("ts").cast("timestamp").alias("ts"),
                        F.col("event_id").alias("order_no"), F.col("event_type").alias("content"))
    seen = drain(t, keyed.bounded_history(replay(t, e), lateness="400 days"), "update")
    # an update with the same newest message may only grow
    return seen.groupBy("session_id").agg(F.max(F.struct("last_order", "size")).alias("m")).select(
        "session_id", F.col("m.size").alias("size"))


@query("stream_cache_put", """
    SELECT key, event_id, value FROM (
      SELECT md5(user_id || '|' || event_type) AS key, event_id, value,
             row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) rn
      FROM events) WHERE rn = 1""")
def stream_cache_put(t):
    """The cache as a log of puts in eight batches, compacted twice on the way."""
    puts = t.events.select(
        F.md5(F.concat_ws("|", F.col("user_id").cast("string"), "event_type")).alias("key"),
        "event_id", "value", F.col("ts").cast("timestamp_ntz").alias("ts"))
    log, version = folder(t, "cache-log"), ["ts", "event_id"]
    schema = "key STRING, event_id BIGINT, value DOUBLE, ts TIMESTAMP_NTZ"
    cachelog.log_puts(replay(t, puts.repartition(8), 1), log, folder(t, "progress"), schema, ["key"], version,
                      every=3).awaitTermination()
    return cachelog.read(t.spark, log, schema, ["key"], version).select("key", "event_id", "value")


# --- ingest --------------------------------------------------------------

def lengths(texts: list[str]) -> list[list[float]]:
    """Stands in for a hosted model; refuses chunks of some lengths."""
    if any(len(x) % 401 == 7 for x in texts):
        raise ValueError("refused")
    return [[float(len(x)), float(x.count(" "))] for x in texts]


def cut_fixed(docs: DataFrame) -> DataFrame:
    pieces = K.fixed_chunks(docs).withColumn("path", F.lit(None).cast("string"))
    return K.build_chunks(pieces).select(
        "doc_id", F.lit(0).alias("section_no"), F.col("chunk_idx").alias("piece_no"),
        F.col("chunk_idx").cast("string").alias("chunk_idx"), "path", "clause", "text")


@query("stream_ingest", """
    WITH u AS (SELECT *, lower(string_split(filename, '.')[-1]) AS ext,
                      row_number() OVER (PARTITION BY filename ORDER BY upload_time, id) AS nth FROM docs),
    k AS (""" + CHUNKED + r"""),
    bad AS (SELECT DISTINCT doc_id FROM k WHERE length(text) % 401 = 7),
    n AS (SELECT doc_id, count(*) AS chunks FROM k GROUP BY doc_id),
    w AS (SELECT doc_id, count(*) AS postings FROM (SELECT DISTINCT doc_id, chunk_idx, u.x FROM k,
            UNNEST(regexp_extract_all(regexp_replace(text, '(\p{Han})', ' \1 ', 'g'), '[\p{L}\p{N}]+')) AS u(x))
          GROUP BY doc_id),
    s AS (SELECT id, filename, CASE WHEN nth > 1 THEN 'refused'
                   WHEN ext NOT IN ('txt', 'md') OR id % 17 = 5 OR content IS NULL OR contains(content, '�')
                     OR id IN (SELECT doc_id FROM bad) THEN 'failed'
                   WHEN id IN (SELECT doc_id FROM n) THEN 'ready' ELSE 'empty' END AS state FROM u)
    SELECT CAST(id AS VARCHAR) AS path, filename, state,
           CASE WHEN state = 'ready' THEN n.chunks ELSE 0 END AS chunk_count,
           CASE WHEN state = 'ready' THEN n.chunks ELSE 0 END AS vectors,
           CASE WHEN state = 'ready' THEN coalesce(w.postings, 0) ELSE 0 END AS postings,
           state IN ('failed', 'refused') AS quarantined
    FROM s LEFT JOIN n ON n.doc_id = s.id LEFT JOIN w ON w.doc_id = s.id""", ("docs", "chunks"))
def stream_ingest(t):
    """All documents as uploaded files, some unreadable or named twice, through one transactional ingest."""
    content = F.when(F.col("id") % 17 == 5, F.unhex(F.lit("FFFF"))).otherwise(F.encode("content", "UTF-8"))
    files = D.docs(t).select("filename", F.col("id").cast("string").alias("path"),
                             F.col("upload_time").cast("timestamp").alias("uploaded"), content.alias("content"))
    base = folder(t, "ingested")
    ingest.ingest(replay(t, files), base, folder(t, "progress"), Embedder(lengths, tries=1),
                  cut=cut_fixed).awaitTermination()
    status, name = ingest.read(t.spark, base, "status"), F.col("doc_id").alias("filename")
    per_file = (ingest.read(t.spark, base, "vectors").groupBy(name).agg(F.count("*").alias("vectors")))
    terms = (ingest.read(t.spark, base, "postings").groupBy(F.substring_index("id", "#", 1).alias("filename"))
             .agg(F.count("*").alias("postings")))
    held = ingest.read(t.spark, base, "quarantine").select("path", F.lit(True).alias("held"))
    ready = F.col("state") == "ready"
    return (status.join(per_file, "filename", "left").join(terms, "filename", "left").join(held, "path", "left")
            .select("path", "filename", "state", "chunk_count",
                    F.when(ready, F.col("vectors")).otherwise(0).alias("vectors"),
                    F.when(ready, F.coalesce("postings", F.lit(0))).otherwise(0).alias("postings"),
                    F.coalesce("held", F.lit(False)).alias("quarantined")))
