"""Shards as a stream: row-wise cleaning and features, and batches per shard.

All operators here are stateless: cleaning and features look at one row, and a
batch never crosses a shard. So there are no watermarks and no state store; the
query checkpoint only remembers which files are done.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from rostrum.operators.batches import DEFAULT_BATCH, whole_shard_batches, with_shard_batches
from rostrum.operators.cleaning import clean
from rostrum.operators.features import with_topic_features
from rostrum.schema import nan_to_null, to_spark_names
from rostrum.session import not_adaptive
from rostrum.sources.readers import shard_name

# A task reads at most spark.sql.files.maxPartitionBytes, so this many read few bytes.
FEW_TASKS = 4
# Files of this size in all are read by one task sooner than a shuffle of them starts.
FEW_BYTES = 8 << 20
# Shards go to streams by the last digit of their number; other names go with the last.
LANES = ("*[01].parquet", "*[23].parquet", "*[45].parquet", "*[67].parquet", "*[!0-7].parquet")


def stream_shards(
    spark: SparkSession,
    directory: str,
    schema: T.StructType,
    files_per_trigger: int | None = None,
    pattern: str = "*.parquet",
    skip: Sequence[str] = (),
) -> DataFrame:
    """Parquet shards as a stream with a ``shard`` column, their path below the directory.

    ``files_per_trigger=1`` gives one shard per micro-batch. Without it a trigger
    takes all new shards, which is what throughput wants. A damaged shard stops the
    stream, so that no half of one gets through; ``skip`` names shards to leave out as a
    whole, as ``readers.damaged_shards`` lists them.
    """
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if skip:
        reader = reader.option("ignoreCorruptFiles", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    name = shard_name(spark, directory, F.col("_metadata.file_path"))
    raw = reader.parquet(directory).select("*", name.alias("shard"))
    kept = raw.filter(~F.col("shard").isin(list(skip))) if skip else raw
    return nan_to_null(to_spark_names(kept))


def stream_lanes(
    spark: SparkSession,
    directory: str,
    schema: T.StructType,
    files_per_trigger: int | None = None,
    skip: Sequence[str] = (),
) -> list[DataFrame]:
    """The shards of a directory dealt by name over several of :func:`stream_shards`.

    A stream runs one micro-batch after another, and small ones take their time from planning
    and from the stream's logs, not from rows. Started together, the streams do this at once.
    Each shard is in one of them, also if it arrives later; a micro-batch of each has at most
    ``files_per_trigger`` shards. Each needs a folder and a checkpoint of its own.
    """
    return [stream_shards(spark, directory, schema, files_per_trigger, lane, skip) for lane in LANES]


def await_all(runs: Sequence[StreamingQuery]) -> None:
    """Wait for streams that run at once; if one fails, the others are stopped."""
    try:
        for run in runs:
            run.awaitTermination()
    finally:
        for run in runs:
            run.stop()


def feature_stream(stream: DataFrame) -> DataFrame:
    """Topic features on a stream: the batch function itself."""
    return with_topic_features(stream)


def clean_stream(stream: DataFrame, modes: Mapping[str, str], **options) -> DataFrame:
    """Cleaning on a stream; the category modes come from an earlier batch job."""
    return clean(stream, modes=modes, **options)


def write_stream(
    stream: DataFrame, path: str, checkpoint: str, partition_by: str | None = None
) -> StreamingQuery:
    """Process all shards present, then stop; the file sink commits each file once."""
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    return (writer.partitionBy(partition_by) if partition_by else writer).start(path)


def _read_bytes(rows: DataFrame) -> int:
    """Bytes of all that a plan reads; very many where it can't tell."""
    leaves = rows._jdf.queryExecution().analyzed().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def stream_shard_batches(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    batch_size: int = DEFAULT_BATCH,
    shuffle: bool = True,
    seed: int = 42,
    key: str = "doc_id",
) -> StreamingQuery:
    """Write each shard as numbered batches, rows shuffled inside their shard.

    Every micro-batch owns one folder and overwrites it, so a repeated micro-batch
    leaves one copy. One that few tasks read is of bounded size: a task numbers a whole
    shard of it, in one job, and one task all shards if they are of few bytes. The rows of a
    larger one are numbered over range partitions.
    """
    number = whole_shard_batches(stream, "shard", batch_size, shuffle, seed, key)

    def store(rows: DataFrame, epoch: int) -> None:
        # Of few bytes, the tasks need not be planned to be counted.
        tasks = 1 if _read_bytes(rows) <= FEW_BYTES else rows.rdd.getNumPartitions()
        if tasks <= FEW_TASKS:
            batched = number(rows, max(tasks, 1))
        else:
            batched = with_shard_batches(rows, "shard", batch_size, shuffle, seed, key)
        # The session is the stream's own.
        with not_adaptive(rows.sparkSession) if tasks == 1 else nullcontext():
            batched.write.mode("overwrite").parquet(f"{path.rstrip('/')}/epoch={epoch}")

    return (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
