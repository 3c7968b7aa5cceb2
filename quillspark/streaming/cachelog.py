"""The cache as a log: deltas per batch, compacted into snapshots of the live keys.

A batch writes the last put of each of its keys. After ``every`` batches the log is compacted:
the snapshot so far and the deltas after it become the next snapshot, which is published by a pointer
(``sources.versions``) with the last batch in it. Readers take the current snapshot and the deltas
after it, so what they read is bounded by the live keys and ``every`` batches. Snapshots and
deltas that neither the current nor the previous version needs are dropped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes as C
from ..sources import versions

EVERY = 8


def _deltas(spark: SparkSession, base: str, schema: str) -> DataFrame:
    if not versions.exists(spark, f"{base}/deltas"):
        return spark.createDataFrame([], f"{schema}, batch_id BIGINT")
    return spark.read.schema(f"{schema}, batch_id BIGINT").parquet(f"{base}/deltas")


def _live(spark: SparkSession, base: str, schema: str, keys: list[str], version: list[str], entry,
          through: int | None = None) -> DataFrame:
    """Live rows: the snapshot of ``entry`` and the deltas after it, up to batch ``through`` if given."""
    after = entry["through"] if entry else -1
    late = _deltas(spark, base, schema).filter(F.col("batch_id") > after)
    if through is not None:
        late = late.filter(F.col("batch_id") <= through)
    late = late.drop("batch_id")
    if entry is None:
        return C.last_change(late, keys, version)
    return C.upsert(spark.read.schema(schema).parquet(entry["folder"]), late, keys, version)


def read(spark: SparkSession, base: str, schema: str, keys: list[str], version: list[str]) -> DataFrame:
    """The last put of every key, as of now."""
    return _live(spark, base, schema, keys, version, versions.current(spark, base))


def compact(spark: SparkSession, base: str, schema: str, keys: list[str], version: list[str], through: int) -> None:
    """Publish a snapshot up to batch ``through``, then drop what only older versions need."""
    entry = versions.current(spark, base)
    folder = f"{base}/snapshots/{uuid.uuid4().hex}"
    _live(spark, base, schema, keys, version, entry, through).write.parquet(folder)
    number = versions.publish(spark, base, folder, through)
    if entry is None:
        return
    # readers that began with the previous version still find its snapshot and the deltas after it
    older = versions.entries(spark, base).filter(F.col("version") == number - 2).collect()  # one entry
    for e in older:
        versions.remove(spark, e["folder"])
    for batch in range(older[0]["through"] + 1 if older else 0, entry["through"] + 1):
        versions.remove(spark, f"{base}/deltas/batch_id={batch}")


def put_batch(batch: DataFrame, batch_id: int, base: str, schema: str, keys: list[str], version: list[str],
              every: int = EVERY) -> None:
    """Add a micro-batch of puts; a batch that is in a snapshot already is not added again."""
    spark = batch.sparkSession
    entry = versions.current(spark, base)
    through = entry["through"] if entry else -1
    if batch_id <= through:
        return
    rows = C.last_change(batch, keys, version).select(*[f.name for f in batch.schema])
    rows.write.mode("overwrite").parquet(f"{base}/deltas/batch_id={batch_id}")
    if batch_id - through >= every:
        compact(spark, base, schema, keys, version, batch_id)


def log_puts(puts: DataFrame, base: str, checkpoint: str, schema: str, keys: list[str], version: list[str],
             every: int = EVERY):
    """A stream of puts into the log, until it is drained."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        put_batch(batch, batch_id, base, schema, keys, version, every)

    return (puts.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
