"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

# For spark-submit or a session builder. The shuffle starts with many small
# partitions and AQE merges them by size, so one setting fits 1 GB and 100 TB.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
    # Checkpoints go when the table does.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


# HotSpot does not compile methods above 8000 bytes of byte code, and fused code
# for 25 topics plus the other columns gets there. Spark then has to split the code
# per expression instead, which is about ten times faster than interpreting it.
_TUNED = {"spark.sql.codegen.hugeMethodLimit": ("65535", "8000")}


def tune(spark: SparkSession) -> SparkSession:
    """Set run-time SQL options the wide table needs, unless the user chose a value."""
    for name, (default, value) in _TUNED.items():
        if spark.conf.get(name) == default:
            spark.conf.set(name, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, set as the checkpoint folder.

    A temporary folder is used only where the setting is absent and the session
    is local, as in tests. On a cluster the setting is required: a folder of one
    machine would be lost with it.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None and sc.getCheckpointDir() is not None:
        configured = sc.getCheckpointDir()
    if configured is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        configured = tempfile.mkdtemp(prefix="rostrum-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    return f"{shared_dir(spark).rstrip('/')}/rostrum/{name}-{uuid.uuid4().hex}"


# A lost map task whose rerun emits other rows makes its consumers rerun, too.
_FULL_RETRY = (
    "spark.sql.shuffle.orderIndependentChecksum.enabled",
    "spark.sql.shuffle.orderIndependentChecksum.enableFullRetryOnMismatch",
)


@contextmanager
def _set_for_now(spark: SparkSession, value: str, *names: str) -> Iterator[None]:
    saved = {name: spark.conf.get(name) for name in names}
    try:
        for name in names:
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in saved.items():
            spark.conf.set(name, value)


def full_retry(spark: SparkSession) -> AbstractContextManager[None]:
    """For jobs with a shuffle whose rows depend on the order they were read in."""
    return _set_for_now(spark, "true", *_FULL_RETRY)


def not_adaptive(spark: SparkSession) -> AbstractContextManager[None]:
    """For many short jobs without a shuffle: each adaptive plan starts a thread on the driver
    that stays for a minute, so they pile up in its memory."""
    return _set_for_now(spark, "false", "spark.sql.adaptive.enabled")


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a table below the shared folder and read it back: fixed rows, no lineage.

    Parquet instead of a checkpoint, so that later steps read only the columns they
    use. The files stay until :func:`discard` or until the shared folder is cleared.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.scratch_path = path
    return stored


def discard(*stored: DataFrame) -> None:
    """Delete what :func:`materialize` stored, once nothing reads it any more."""
    for df in stored:
        delete_path(df.sparkSession, df.scratch_path)


def _located(spark: SparkSession, path: str):
    """The file system a path is of, and the path for it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any file system Spark reaches."""
    system, target = _located(spark, path)
    system.delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    system, target = _located(spark, path)
    return system.exists(target)


def is_folder(spark: SparkSession, path: str) -> bool:
    system, target = _located(spark, path)
    return system.getFileStatus(target).isDirectory()


def make_folder(spark: SparkSession, path: str) -> None:
    system, target = _located(spark, path)
    system.mkdirs(target)


def move_path(spark: SparkSession, source: str, target: str) -> None:
    system, found = _located(spark, source)
    if not system.rename(found, _located(spark, target)[1]):
        raise OSError(f"cannot move {source} to {target}")


def move_paths(spark: SparkSession, moves: Sequence[tuple[str, str]]) -> None:
    """Move many files of one file system."""
    if not moves:
        return
    system, _ = _located(spark, moves[0][0])
    path = spark._jvm.org.apache.hadoop.fs.Path

    def move(pair: tuple[str, str]) -> None:
        source, target = pair
        if not system.rename(path(source), path(target)):
            raise OSError(f"cannot move {source} to {target}")

    # Each is a call that waits for the file system.
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(move, moves))


def list_paths(spark: SparkSession, folder: str) -> list[str]:
    """Files and folders right below a folder."""
    system, target = _located(spark, folder)
    return sorted(s.getPath().toString() for s in system.listStatus(target))


def list_below(spark: SparkSession, folder: str) -> list[str]:
    """Files and folders below the folders of a folder, in few calls however many they are."""
    system, target = _located(spark, folder)
    jvm = spark._jvm
    paths = jvm.org.apache.hadoop.fs.FileUtil.stat2Paths
    below = paths(system.listStatus(paths(system.listStatus(target))))
    joined = jvm.scala.Predef.genericWrapArray(below).mkString("\n")
    return sorted(joined.split("\n")) if joined else []


def filesystem_uri(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the file system that Spark takes it for."""
    system, target = _located(spark, path)
    uri = system.makeQualified(target).toString()
    return uri.replace("file:/", "file:///", 1) if not uri.startswith("file://") else uri
