"""Token ids in Parquet list columns, written in document order and readable in part.

One row per document: doc_id, its place among all ids, its length and its ids.
Ids are dictionary-encoded (a vocabulary's distinct ids fit one dictionary
page); the numbers beside them are delta-encoded. Row groups and pages are
small enough for selective reads, and files carry page indexes, so a read of a
range of doc_ids or of the numbers alone skips the rest. Files are split by
ranges of doc_id and ordered inside; ``start`` counts inside the file, and a
small table of file totals gives the ids before each file.

Defined cases: null text is empty (only the end id); a null doc_id comes first;
repeated rows are written one by one; an empty table gives empty files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .encoder import encoder
from .tables import text_of

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 500
FILE_TEXT_BYTES = 64 << 20
WRITER = {
    "parquet.writer.version": "PARQUET_2_0",  # delta encodings, page indexes
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.page.row.count.limit": str(PAGE_ROWS),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#local_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "compression": "zstd",
}


def _encode_rows(path: str, end_id: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, before, part = encoder(path), 0, None
        for batch in batches:
            for first, ids, counts in coder.documents(batch.column(1)):
                n = len(counts)
                full = counts + 1
                ends = np.cumsum(full)
                out = np.full(int(ends[-1]), end_id, np.int32)
                inside = np.ones(len(out), bool)
                inside[ends - 1] = False
                out[inside] = ids
                starts = before + ends - full
                before += int(ends[-1])
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(out))
                yield pa.record_batch(
                    [batch.column(0).slice(first, n), pa.array(starts), pa.array(full.astype(np.int32)), lists,
                     batch.column(2).slice(first, n)],
                    names=["doc_id", "local_start", "n_tokens", "ids", "part"])
    return run


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode all documents and write them in ascending doc_id order under ``path``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    files = max(1, -(-int(total) // FILE_TEXT_BYTES))
    ordered = (rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", F.octet_length("text"))
               .withColumn("part", F.spark_partition_id()))
    encoded = ordered.mapInArrow(
        _encode_rows(tokenizer, end_id),
        "doc_id long, local_start long, n_tokens int, ids array<int>, part int")
    encoded.write.options(**WRITER).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and n_tokens of every document; the ids are not read."""
    rows = spark.read.parquet(path).select("doc_id", "local_start", "n_tokens", "part")
    return _placed(rows, spark, path)


def read_tokens(spark: SparkSession, path: str, where: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids; a condition on doc_id skips row groups and pages."""
    rows = spark.read.parquet(path)
    return _placed(rows.where(where) if where else rows, spark, path)


def _placed(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    totals = (spark.read.parquet(path).groupBy("part")
              .agg(F.sum(F.col("n_tokens").cast("long")).alias("n")))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per file
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return (rows.join(bases, "part")
            .withColumn("start", F.col("base") + F.col("local_start"))
            .drop("part", "base", "local_start"))


def _checksum_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        values = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        sums, at = [], 0
        for end in ends.tolist():
            sums.append(zlib.crc32(values[at:end]))
            at = end
        yield pa.record_batch(
            [batch.column("doc_id"), batch.column("start"), pa.array(np.diff(ends, prepend=0).astype(np.int64)),
             pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the checksum of the ids as little-endian 32-bit numbers."""
    return tokens.select("doc_id", "start", "ids").mapInArrow(
        _checksum_rows, "doc_id long, start long, n_tokens long, ids_crc32 long")
