"""Readers and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .schemas import FRAME_JSON, TABLES


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.schema(TABLES[table]).parquet(path)


def decode_text(content: Column) -> Column:
    """Bytes as UTF-8, or as GBK when they are not valid UTF-8; bytes that are neither are replaced."""
    return (F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8"))
            .otherwise(F.decode(content, "GBK")))


def allow_gbk(spark: SparkSession) -> None:
    """GBK is outside Spark's default charset list; this switches the JVM's list on."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    # one bad file must not end the job
    spark.conf.set("spark.sql.legacy.codingErrorAction", "true")


def read_text_files(spark: SparkSession, path: str, nested: bool = False) -> DataFrame:
    """(path, text) of whole text files.

    ``nested``: those in all folders below, whose names are no columns. Spark lists a folder of folders in a
    task, with what is in it, so many files should lie in some hundred folders of their own.
    """
    allow_gbk(spark)
    files = spark.read.format("binaryFile")
    if nested:
        files = files.option("recursiveFileLookup", "true")
    return files.load(path).select("path", decode_text(F.col("content")).alias("text"))


def append_rows(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def replace_rows(df: DataFrame, path: str) -> None:
    """Full refresh: everything out, everything in."""
    df.write.mode("overwrite").parquet(path)


def append_vectors(df: DataFrame, path: str) -> None:
    """(id, v[, cell]); partitioned by cell once cells are assigned."""
    append_rows(df, path, ["cell"] if "cell" in df.columns else None)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of an event stream file, split on blank lines."""
    return parse_frames(spark.read.option("lineSep", "\n\n").text(path))


def parse_frames(blocks: DataFrame, value: str = "value") -> DataFrame:
    """Keep ``data:`` blocks with a readable payload; a bad payload parses to nulls."""
    body = F.regexp_replace(F.col(value), r"^data:\s*", "")
    return (blocks.filter(F.col(value).startswith("data:"))
            .withColumn("j", F.from_json(body, FRAME_JSON))
            .filter(F.col("j.type").isNotNull())
            .withColumns({"type": F.col("j.type"), "data": F.col("j.data")})
            .drop("j", value))


def with_schema(df: DataFrame, table: str) -> DataFrame:
    """Project onto a table's declared schema; absent columns become null."""
    fields = StructType.fromDDL(TABLES[table]).fields
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None))
                       .cast(f.dataType).alias(f.name) for f in fields])
