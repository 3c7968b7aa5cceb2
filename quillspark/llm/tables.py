"""Reading the inputs and joins that stay even under hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import tune

SALTS = 8
# rows per batch between the JVM and Python: texts are long, and a batch is held on both sides
BATCH_ROWS = 2000


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the library's settings, and batches that suit texts."""
    tune(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def text_of(docs: DataFrame) -> Column:
    """The text of a document; null counts as empty."""
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def salted_left_join(left: DataFrame, right: DataFrame, key: str, spread: Column) -> DataFrame:
    """Left join on ``key`` where one key may hold a third of ``left``.

    ``right`` has one row per key. Its rows are repeated once per salt, and the
    rows of a hot key go to as many partitions; AQE may split those further.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return salted.join(copies, [key, "_salt"], "left").drop("_salt")


def least_hashes(rows: DataFrame, sizes: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """(key, group) of the ``n`` rows of least key hashes in every group, fewer only where there are fewer.

    ``sizes`` (group, rows) counts the groups. A large group first loses the hashes above a bound
    under which about 2 n + 40 of its rows lie (fewer than n: never in practice, and then a few rows less),
    so no task ranks a group. Null groups are left out.
    """
    from pyspark.sql import Window as W

    share = F.least(F.lit(1.0), (2.0 * n + 40) / F.col("rows"))
    hashed = rows.withColumn("hash", F.xxhash64(key))
    low = F.shiftrightunsigned("hash", 33).cast("double") <= share * float(1 << 31)
    few = hashed.join(sizes.select(group, "rows"), group).where(low)  # one row per group: sent along while small
    first = W.partitionBy(group).orderBy(F.shiftrightunsigned("hash", 33), "hash", key)
    return few.withColumn("place", F.row_number().over(first)).where(F.col("place") <= n).select(key, group)


def dense_rank_slots(rows: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """Number the rows of every group from 0 without holding a group in one task.

    Rows are dealt to hash buckets inside their group, counted per bucket, and
    numbered in the bucket behind the rows of the buckets before it. The bucket
    count follows the session's shuffle partitions. Ties of ``order`` take any order.
    """
    from pyspark.sql import Window as W

    buckets = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(order), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    before = W.partitionBy(group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select(group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = W.partitionBy(group, "_bucket").orderBy(order)
    return (dealt.withColumn("_row", F.row_number().over(inside).cast("long") - 1)
            .join(bases, [group, "_bucket"])
            .withColumn(name, F.col("_base") + F.col("_row"))
            .drop("_bucket", "_row", "_base"))
