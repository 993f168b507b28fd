"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Spark's setting to remove the shuffle files of a query when it ends.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the jobs are written for. Cluster settings win."""
    builder = SparkSession.builder.appName("webloom")
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Pages are large rows: small Arrow batches keep Python workers small.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
        "spark.sql.streaming.stateStore.providerClass": (
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        ),
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; in local tests, where none is named, a new one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        folder = context.getCheckpointDir()
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder``, a path below the shared folder, with the scheme of the file system that Spark writes it to."""
    probe = scratch_path(spark, "probe")
    spark.range(1).coalesce(1).write.parquet(probe)
    written = spark.read.parquet(probe).inputFiles()[0].rpartition("/")[0]
    return os.path.join(os.path.dirname(written), os.path.basename(folder))


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` read back from a reliable checkpoint, for loops over joins."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = shared_folder(df.sparkSession)
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(folder)
    return df.checkpoint()


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written once below the shared folder and read back.

    For costly rows that are used more than once: later stages read only the
    columns they need, and a lost executor re-reads files instead of parsing
    again. The shuffle files of the write go when it ends, not when the driver
    happens to collect its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEAN_SHUFFLES, "false")
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)
    return spark.read.parquet(path)
