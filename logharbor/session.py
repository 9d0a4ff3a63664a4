"""Spark session settings and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Session option that frees the shuffle files of a finished write at once.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# AQE picks broadcasts from measured sizes, splits skewed join partitions and
# coalesces small ones; nothing in the library hints a join by hand.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # the JVM never compiles methods above 8000 bytes of bytecode; generated line
    # parsers that exceed it run faster split into small methods
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set the runtime options the jobs rely on."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read, named by ``spark.checkpoint.dir``.

    Only a local-mode session without the setting gets a temporary folder; on a
    cluster a missing setting is an error, because a machine-local folder would
    be lost with its machine.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    current = spark.sparkContext.getCheckpointDir()
    if named:
        if current is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if current is None:
        if not is_local(spark):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="logharbor-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame to the shared folder and read it back.

    The table outlives the executors that wrote it.  Unlike an eager checkpoint it
    is computed once, and its known size lets AQE choose the joins that follow.
    Shuffle files behind it are freed when the write ends.
    """
    spark = df.sparkSession
    folder, before = new_folder(spark, "cut"), spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(folder)
