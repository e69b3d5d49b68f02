"""Category counts kept as the state of a stream, and cleaning with the mode so far.

A stream has no final counts, so the fill of missing categories needs state. A query of
its own counts the values of each category column; its counts live in the state store
below its checkpoint, commit with each micro-batch and survive a restart. Nothing else
stores them: the cleaning stream reads the state itself as a table.

The state holds a count per distinct value, however many rows arrive. Values that are
missing are not counted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from rostrum.operators.cleaning import clean, drop_short_text
from rostrum.schema import CATEGORY_COLUMNS, MIN_TEXT_LENGTH
from rostrum.session import path_exists

COUNTS = "column string, value string, n long"


def count_categories(
    stream: DataFrame,
    checkpoint: str,
    columns: Sequence[str] = CATEGORY_COLUMNS,
    min_length: int | None = MIN_TEXT_LENGTH,
) -> StreamingQuery:
    """Add what has arrived since the last run to the counts per column and value, then stop.

    ``min_length`` leaves out the rows that cleaning drops for their short text, so that
    the mode is that of the cleaned rows; None counts all rows. The number of state
    partitions is that of the first run's shuffle.
    """
    present = [c for c in columns if c in stream.columns]
    if not present:
        raise ValueError(f"none of the columns {list(columns)} is in the stream")
    rows = stream if min_length is None else drop_short_text(stream, min_length)
    values = rows.select(*[F.col(c).cast("string").alias(c) for c in present])
    counts = (
        values.unpivot([], present, "column", "value")
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
    )
    return (
        counts.writeStream.format("noop")
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def category_counts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``(column, value, n)`` as of the last micro-batch that was committed.

    Empty if none was, e.g. before the first shard.
    """
    if not path_exists(spark, f"{checkpoint.rstrip('/')}/state"):
        return spark.createDataFrame([], COUNTS)
    state = spark.read.format("statestore").load(checkpoint)
    return state.selectExpr("key.column", "key.value", "value.count AS n")


def modes_so_far(spark: SparkSession, checkpoint: str) -> dict[str, str]:
    """Most common value per column, the smallest on ties; columns without values are absent."""
    best = F.min_by("value", F.struct(-F.col("n"), F.col("value")))
    modes = category_counts(spark, checkpoint).groupBy("column").agg(best.alias("mode"))
    return dict(modes.collect())  # a row per category column


def clean_by_counts(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    counts_checkpoint: str,
    **options,
) -> StreamingQuery:
    """Clean all shards present, each micro-batch with the mode counted so far, then stop.

    Run :func:`count_categories` over the same shards first, to its end; shards that come
    in between are cleaned with the counts from before them. Rows written earlier keep
    the mode of their time, also when another value overtakes it. Every micro-batch owns
    one folder, ``epoch=N`` below ``path``, and overwrites it, so a repeated one leaves
    one copy.
    """

    def store(rows: DataFrame, epoch: int) -> None:
        modes: Mapping[str, str] = modes_so_far(rows.sparkSession, counts_checkpoint)
        cleaned = clean(rows, modes=modes, **options)
        cleaned.write.mode("overwrite").parquet(f"{path.rstrip('/')}/epoch={epoch}")

    return (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
