"""Session settings and the two places where a job may leave data behind."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import skywell
from pyspark import cloudpickle, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# Functions of this package travel to the Python workers with the task, so executors need no copy of it.
cloudpickle.register_pickle_by_value(skywell)

SESSION_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Streaming state larger than executor memory stays on disk; only changes are uploaded.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build_session(app: str = "skywell", master: str | None = None, **extra: str) -> SparkSession:
    """Session with the settings every operator assumes (UTC, AQE, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def keyed_state(spark: SparkSession) -> None:
    """Queries started from now on keep their state in RocksDB: keyed state with timers needs a store with column
    families, which Spark's default one lacks, and a session may come without the settings above."""
    for key, value in SESSION_SETTINGS.items():
        if key.startswith("spark.sql.streaming.stateStore."):
            spark.conf.set(key, value)


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_root(spark: SparkSession) -> str:
    """Folder all executors can reach: the one the session names, else a local one on local masters."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named
    if not _is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    existing = spark.conf.get("skywell.scratch", None)
    if existing is None:
        existing = tempfile.mkdtemp(prefix="skywell-")
        spark.conf.set("skywell.scratch", existing)
    return existing


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so a later job re-reads the same rows."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(os.path.join(shared_root(df.sparkSession), "checkpoints"))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, in_order: bool = False) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder; later jobs read its columns as they need them.

    ``in_order``: files of one size are read in the order of their tasks, not as the file system lists them, so
    that the same rows come in the same order each time.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    files = [path]
    if in_order:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
        files = sorted(f.getPath().toString() for f in found if f.getPath().getName().startswith("part-")) or files
    return spark.read.schema(df.schema).parquet(*files)


def side_by_side(spark: SparkSession, *steps: Callable) -> list:
    """Results of independent steps: their jobs share the executors instead of each waiting for the last task of the one before."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [done.result() for done in [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]]
