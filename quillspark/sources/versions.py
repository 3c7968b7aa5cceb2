"""Versions of a table in a folder: written beside each other, published by a pointer.

A version's rows are complete before its pointer entry appears, and entries are only ever
added. The current version is the entry of the largest number; a reader that has taken
an entry keeps reading that version, whatever is published meanwhile, until it is dropped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ENTRY = "folder STRING, through BIGINT, version BIGINT"


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def entries(spark: SparkSession, base: str) -> DataFrame:
    """(folder, through, version) of all versions published."""
    if not exists(spark, f"{base}/pointers"):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).parquet(f"{base}/pointers")


def current(spark: SparkSession, base: str):
    """The entry (folder, through, version) that readers follow now; None before the first."""
    return entries(spark, base).orderBy(F.desc("version")).first()


def publish(spark: SparkSession, base: str, folder: str, through: int = -1) -> int:
    """Make ``folder`` the current version. Of two writers of one number, the second fails."""
    last = current(spark, base)
    number = last["version"] + 1 if last else 0
    (spark.createDataFrame([(folder, through)], "folder STRING, through BIGINT").coalesce(1)
     .write.parquet(f"{base}/pointers/version={number}"))
    return number


def refresh(rows: DataFrame, base: str, keep: int = 2) -> int:
    """Full refresh: ``rows`` become the next version; versions older than the last ``keep`` are dropped."""
    spark = rows.sparkSession
    folder = f"{base}/versions/{uuid.uuid4().hex}"
    rows.write.parquet(folder)
    number = publish(spark, base, folder)
    old = entries(spark, base).filter(F.col("version") == number - keep).collect()  # one entry
    for entry in old:
        remove(spark, entry["folder"])
    return number


def read(spark: SparkSession, base: str, schema: str | StructType, version: int | None = None) -> DataFrame:
    """The rows of a version, the current one unless given. The choice is made here, not when rows are read."""
    if version is None:
        entry = current(spark, base)
    else:
        entry = entries(spark, base).filter(F.col("version") == version).first()
        if entry is None:
            raise ValueError(f"no version {version}")
    if entry is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(entry["folder"])
