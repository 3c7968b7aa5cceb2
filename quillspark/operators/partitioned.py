"""State tables stored by hash partition of their keys; a change rewrites only the partitions it touches.

Changes are reduced to the last one per key and routed by the key's partition. Only the
partitions that a change falls into are read, merged and written again (dynamic partition
overwrite); files of all others stay as they are. A merge is complete in the shared
folder before a partition is replaced, so a lost executor or a repeated merge changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import written
from ..sources.versions import remove
from . import changes as C


@dataclass(frozen=True)
class PartitionedState:
    """A table in ``path`` with unique ``keys``; ``parts`` is chosen so that a partition suits a task.

    ``route`` are the keys that choose the partition (all unless given): a table whose rows are deleted by
    session, say, is routed by session.
    """

    spark: SparkSession
    path: str
    schema: str
    keys: tuple[str, ...]
    version: tuple[str, ...]
    parts: int
    route: tuple[str, ...] = ()

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*(self.route or self.keys)), F.lit(self.parts)).cast("int").alias("part")

    def _columns(self) -> list[str]:
        return StructType.fromDDL(self.schema).names

    def create(self, rows: DataFrame) -> None:
        self._put(rows.select(*self._columns()).withColumn("part", self._part()))

    def _put(self, rows: DataFrame) -> None:
        (rows.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("part").parquet(self.path))

    def stored(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, part INT").parquet(self.path)

    def read(self) -> DataFrame:
        return self.stored().select(*self._columns())

    def _rewrite(self, routed: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        touched = sorted(r["part"] for r in routed.select("part").distinct().collect())  # at most ``parts``
        if not touched:
            return []
        held = self.stored().filter(F.col("part").isin(touched))
        merged = written(merge(held.select(*self._columns()), routed.drop("part")).withColumn("part", self._part()))
        self._put(merged)
        # what has no row any more is not overwritten
        left = {r["part"] for r in merged.select("part").distinct().collect()}
        for part in set(touched) - left:
            remove(self.spark, f"{self.path}/part={part}")
        return touched

    def upsert(self, changes: DataFrame) -> list[int]:
        """Merge changes, the last one by version wins; returns the partitions that were rewritten."""
        last = C.last_change(changes.select(*self._columns()), list(self.keys), list(self.version))
        return self._rewrite(written(last.withColumn("part", self._part())),
                             lambda held, new: C.upsert(held, new, list(self.keys), list(self.version)))

    def delete(self, keys: DataFrame) -> list[int]:
        """Delete the rows of ``keys``: all key columns, or the ones the table is routed by."""
        on = [k for k in self.keys if k in keys.columns]
        if not set(self.route or self.keys) <= set(on):
            raise ValueError("the columns that choose the partition are needed")
        routed = written(keys.select(*on).distinct().withColumn("part", self._part()))
        return self._rewrite(routed, lambda held, gone: C.delete_keys(held, gone, on))
