"""foreachBatch sinks. Every write goes to a folder named after the batch, so a
repeated batch replaces its own rows and nothing is counted twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import changes as C
from ..operators import chunking as K
from ..operators import sparse as S
from ..sources import io

CHUNK_ROWS = "doc_id STRING, section_no INT, piece_no INT, path STRING, clause STRING, text STRING"
POSTING_ROWS = "term STRING, id STRING, tf BIGINT, dl INT"


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_batches(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path).drop("batch_id")


def file_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Newly uploaded files of the accepted types: (doc_id, text)."""
    io.allow_gbk(spark)
    reader = spark.readStream.format("binaryFile").schema(
        "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    from ..functions.text import file_extension, parser_route

    return (reader.load(path)
            .filter(parser_route(file_extension(F.col("path"))) != "rejected")
            .select(F.col("path").alias("doc_id"), io.decode_text(F.col("content")).alias("text")))


def ingest(files: DataFrame, chunk_path: str, postings_path: str, checkpoint: str):
    """File stream -> chunk table and postings, batch by batch."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        write_batch(K.chunk_documents(batch), chunk_path, batch_id)
        # read back what was written: the files are parsed once
        chunks = batch.sparkSession.read.schema(CHUNK_ROWS).parquet(
            f"{chunk_path}/batch_id={batch_id}")
        keyed = chunks.select(F.concat_ws("#", "doc_id", "section_no", "piece_no").alias("id"), "text")
        write_batch(S.build_postings(keyed), postings_path, batch_id)

    return (files.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def log_cache_puts(puts: DataFrame, path: str, checkpoint: str, version: list[str] | None = None):
    """Answer stream -> log of keyed puts; only the last one (by ``version``) per key and batch is written."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        write_batch(C.last_change(batch, ["key"], version or ["ts"]), path, batch_id)

    return (puts.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_cache(spark: SparkSession, path: str, schema: str, version: list[str] | None = None) -> DataFrame:
    """The cache as of now: last put per key over the log."""
    return C.last_change(read_batches(spark, path, schema), ["key"], version or ["ts"])
