"""Ingest as one commit: each micro-batch of files writes several tables and then one manifest entry.

Every attempt at a batch writes to folders of its own, ``<table>/batch_id=<n>/attempt=<id>``.
The manifest entry, written last, names the attempt; readers follow the manifest and see all
of a batch's rows in all tables or none. A batch that is replayed after its commit is skipped,
one that was cut off before it is done again, and what the first attempt left is never read.

Files of a batch go through name check, type check, decoding, cutting and embedding. A file that
fails at any of these is kept in ``quarantine`` with its reason; the others go on.

Tables: ``status`` (one row per file given), ``chunks``, ``vectors``, ``postings``, ``quarantine``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params as P
from ..functions.text import file_extension
from ..operators import chunking as K
from ..operators import sparse as S
from ..operators.dense import Embedder, embed_or_fail
from ..sources import io
from ..sources.versions import exists

TABLES = {
    "status": "filename STRING, path STRING, state STRING, reason STRING, chunk_count BIGINT, uploaded TIMESTAMP",
    "chunks": "doc_id STRING, section_no INT, piece_no INT, chunk_idx STRING, path STRING, clause STRING, text STRING",
    "vectors": "id STRING, doc_id STRING, v ARRAY<FLOAT>",
    "postings": "term STRING, id STRING, tf BIGINT, dl INT",
    "quarantine": "filename STRING, path STRING, reason STRING, content BINARY",
}
MANIFEST = "attempt STRING, batch_id BIGINT"
KEYS = ", batch_id BIGINT, attempt STRING"
TEXT_TYPES = ("txt", "md")


def manifest(spark: SparkSession, base: str) -> DataFrame:
    """(attempt, batch_id) of the committed batches."""
    if not exists(spark, f"{base}/manifest"):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{base}/manifest")


def read(spark: SparkSession, base: str, table: str) -> DataFrame:
    """The committed rows of a table; folders of other attempts are pruned."""
    if not exists(spark, f"{base}/{table}"):
        return spark.createDataFrame([], TABLES[table])
    rows = spark.read.schema(TABLES[table] + KEYS).parquet(f"{base}/{table}")
    # the manifest has one row per batch: Spark sends it along while it is small
    return rows.join(manifest(spark, base), ["batch_id", "attempt"], "left_semi").drop("batch_id", "attempt")


def decode_plain(content: Column, ext: Column) -> Column:
    """Text of plain files; null for other types and for bytes that are neither UTF-8 nor GBK."""
    text = io.decode_text(content)
    return F.when(ext.isin(*TEXT_TYPES) & ~text.contains("�"), text)


def triage(files: DataFrame, known: DataFrame, decode: Callable[[Column, Column], Column]) -> DataFrame:
    """(filename, path, uploaded, content, text, reason): reason is null for files that go on.

    Of files of one name the first counts, and none if the name is ``known``.
    """
    ext = file_extension(F.col("filename"))
    order = F.struct("uploaded", "path")
    first = files.groupBy("filename").agg(F.min(order).alias("first"))
    checked = (files.join(first, "filename").join(known.select("filename", F.lit(True).alias("known")), "filename", "left")
               .withColumn("reason", F.when(F.col("known") | (order != F.col("first")), "name exists")
                           .when(~ext.isin(*P.ALLOWED_EXTENSIONS), "type not accepted")))
    text = F.when(F.col("reason").isNull(), decode(F.col("content"), ext))
    return (checked.withColumn("text", text)
            .withColumn("reason", F.when(F.col("reason").isNull() & F.col("text").isNull(), "not readable")
                        .otherwise(F.col("reason")))
            .select("filename", "path", "uploaded", "content", "text", "reason"))


def chunk_key(chunk: DataFrame) -> Column:
    return F.concat_ws("#", chunk["doc_id"], chunk["chunk_idx"])


def cut_markdown(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> chunk rows of Markdown documents."""
    return K.chunk_documents(docs).withColumn("chunk_idx", F.concat_ws(".", "section_no", "piece_no"))


def ingest_batch(batch: DataFrame, batch_id: int, base: str, embedder: Embedder,
                 cut: Callable[[DataFrame], DataFrame] = cut_markdown,
                 decode: Callable[[Column, Column], Column] = decode_plain, tokenizer=None) -> None:
    """One micro-batch of (filename, path, uploaded, content); does nothing if the batch is committed."""
    spark = batch.sparkSession
    io.allow_gbk(spark)
    done = manifest(spark, base).filter(F.col("batch_id") == batch_id)
    if not done.isEmpty():
        return
    attempt = uuid.uuid4().hex

    def put(df: DataFrame, table: str) -> DataFrame:
        path = f"{base}/{table}/batch_id={batch_id}/attempt={attempt}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    known = read(spark, base, "status").filter(F.col("state") != "refused").select("filename").distinct()
    files = put(triage(batch.select("filename", "path", "uploaded", "content"), known, decode), "triaged")
    going = files.filter("reason is null").select(F.col("filename").alias("doc_id"), "text")
    # one pass cuts and embeds; a document of which a chunk fails is kept back whole
    made = put(embed_or_fail(cut(going), "text", embedder), "made")
    failed = made.filter("error is not null").select("doc_id").distinct()
    good = made.join(failed, "doc_id", "left_anti")
    chunks = put(good.select(*[f.split()[0] for f in TABLES["chunks"].split(", ")]), "chunks")
    put(good.select(chunk_key(good).alias("id"), "doc_id", "v"), "vectors")
    put(S.build_postings(chunks.select(chunk_key(chunks).alias("id"), "text"), tokenizer), "postings")
    counts = chunks.groupBy(F.col("doc_id").alias("filename")).agg(F.count("*").alias("chunk_count"))
    errors = (made.filter("error is not null").groupBy(F.col("doc_id").alias("filename"))
              .agg(F.min("error").alias("error")))
    status = (files.filter(F.coalesce("reason", F.lit("")) != "name exists").join(counts, "filename", "left")
              .join(errors, "filename", "left")
              .withColumn("reason", F.coalesce("reason", F.concat(F.lit("embedding: "), "error"))))
    state = (F.when(F.col("reason").isNull() & (F.col("chunk_count") > 0), "ready")
             .when(F.col("reason").isNull(), "empty").otherwise("failed"))
    again = files.filter("reason = 'name exists'").withColumns({"state": F.lit("refused"), "chunk_count": F.lit(0)})
    columns = [f.split()[0] for f in TABLES["status"].split(", ")]
    rows = (status.withColumn("state", state).withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
            .select(*columns).unionByName(again.select(*columns))
            .withColumn("chunk_count", F.col("chunk_count").cast("bigint")))
    written = put(rows, "status")
    bad = written.filter("state in ('failed', 'refused')").select("path", F.col("reason").alias("why"))
    put(files.join(bad, "path").select("filename", "path", F.col("why").alias("reason"), "content"), "quarantine")
    # the commit: one small file that appears at once
    (spark.createDataFrame([(attempt,)], "attempt STRING").coalesce(1)
     .write.parquet(f"{base}/manifest/batch_id={batch_id}"))


def ingest(files: DataFrame, base: str, checkpoint: str, embedder: Embedder, **how):
    """Run ``ingest_batch`` over a stream of files until it is drained."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, batch_id, base, embedder, **how)

    return (files.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def uploads(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """New files of a folder as a stream of (filename, path, uploaded, content)."""
    reader = spark.readStream.format("binaryFile").schema(
        "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    name = F.element_at(F.split("path", "/"), -1)
    return reader.load(path).select(F.url_decode(name).alias("filename"), "path",
                                    F.col("modificationTime").alias("uploaded"), "content")
