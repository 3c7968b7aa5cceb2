"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings that the jobs rely on; anything else stays with the cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even where that costs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # GBK text is decoded by read_text_fallback
    "spark.sql.legacy.javaCharsets": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app_name: str = "quillspark", master: str | None = None,
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Put the run-time settings above on a session that was built elsewhere."""
    # without RocksDB no stream with keyed state starts
    for key in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled",
                "spark.sql.adaptive.forceOptimizeSkewedJoin", "spark.sql.streaming.stateStore.providerClass"):
        spark.conf.set(key, DEFAULTS[key])
    return ship(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    A machine-local folder is made only where there is one machine (a local
    master); elsewhere executors would not see each other's files.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if current is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current is None:
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="quillspark-checkpoint-")
        spark.sparkContext.setCheckpointDir(current)
    return current


def _is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application, for functions that run there."""
    context = spark.sparkContext
    name = f"quillspark-{context.applicationId}.zip"
    if not any(os.path.basename(f) == name for f in context._python_includes):
        top = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="quillspark-package-"), name)
        with zipfile.ZipFile(path, "w") as out:
            for folder, _, files in os.walk(top):
                for f in sorted(files):
                    if f.endswith(".py"):
                        full = os.path.join(folder, f)
                        out.write(full, os.path.relpath(full, os.path.dirname(top)))
        context.addPyFile(path)
    return spark


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-spread a table that is read in fewer splits than there are cores.

    Such a table is small for the cluster at hand (cores x split size); a larger
    one already has a split per core and is left where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def written(df: DataFrame, codec: str | None = None) -> DataFrame:
    """The rows written once to a table in the shared folder and read back; ``codec`` is for large ones.

    For results that several branches of one job use: they are computed once,
    survive the loss of executors and give the planner real sizes.
    """
    path = f"{_own_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _own_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/{spark.sparkContext.applicationId}"


def drop_written(spark: SparkSession) -> None:
    """Delete all tables that ``written`` made in this application."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
