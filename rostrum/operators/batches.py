"""Batches of rows, as rows with a ``batch_id`` or as arrays per column."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window, functions as F

from rostrum.operators.numbering import ROW_ID, hash_key, number_by_key, number_shuffled, row_tie
from rostrum.schema import topic_columns

BATCH_ID = "batch_id"
DEFAULT_BATCH = 32


def model_columns(df: DataFrame) -> list[str]:
    """Columns that become 32-bit floats in model-ready batches."""
    return topic_columns(df) + [c for c in ("congno", "training_set") if c in df.columns]


def with_batches(
    df: DataFrame,
    batch_size: int = DEFAULT_BATCH,
    shuffle: bool = True,
    seed: int = 42,
    key: str = "doc_id",
) -> DataFrame:
    """Add ``row_id`` and ``batch_id``; all batches but the last are full."""
    numbered = number_shuffled(df, seed, key) if shuffle else number_by_key(df, [key])
    return numbered.select(
        F.floor(F.col(ROW_ID) / batch_size).cast("long").alias(BATCH_ID), ROW_ID, *df.columns
    )


def with_shard_batches(
    df: DataFrame,
    shard: str = "shard",
    batch_size: int = DEFAULT_BATCH,
    shuffle: bool = True,
    seed: int = 42,
    key: str = "doc_id",
) -> DataFrame:
    """Batches that never cross shards; rows are shuffled inside their shard.

    Rows are numbered over range partitions by shard and order, so a shard of any size
    spreads over tasks; one row per shard, its first position, is joined on.
    """
    order = [hash_key(seed, key), F.col(key)] if shuffle else [F.col(key)]
    numbered = number_by_key(df, [F.col(shard), *order], name="__global")
    starts = numbered.groupBy(F.col(shard).alias("__shard")).agg(
        F.min("__global").alias("__start")
    )
    placed = numbered.join(starts, F.col(shard).eqNullSafe(F.col("__shard"))).withColumn(
        ROW_ID, F.col("__global") - F.col("__start")
    )
    return placed.select(
        shard,
        F.floor(F.col(ROW_ID) / batch_size).cast("long").alias(BATCH_ID),
        F.col(ROW_ID).cast("long").alias(ROW_ID),
        *[c for c in df.columns if c != shard],
    )


def whole_shard_batches(
    df: DataFrame,
    shard: str = "shard",
    batch_size: int = DEFAULT_BATCH,
    shuffle: bool = True,
    seed: int = 42,
    key: str = "doc_id",
) -> Callable[[DataFrame, int], DataFrame]:
    """What gives :func:`with_shard_batches` for small shards, in one job that stores nothing.

    ``df`` names the columns; its micro-batches are numbered by the same expressions. A shard
    is sorted and numbered by one task, and the shards are dealt over the given number of
    tasks. One task takes them as they are read, without a shuffle.
    """
    order = [hash_key(seed, key), F.col(key)] if shuffle else [F.col(key)]
    place = F.row_number().over(Window.partitionBy(shard).orderBy(*order, row_tie(df))) - 1
    row = place.cast("long")
    batch = F.floor(F.col(ROW_ID) / batch_size).cast("long").alias(BATCH_ID)
    columns = [F.col(shard), batch, F.col(ROW_ID), *[F.col(f"`{c}`") for c in df.columns if c != shard]]

    def number(rows: DataFrame, tasks: int) -> DataFrame:
        dealt = rows.coalesce(1) if tasks == 1 else rows.repartition(tasks, shard)
        return dealt.withColumn(ROW_ID, row).select(*columns)

    return number


def columnar_batches(
    batched: DataFrame, columns: Sequence[str] | None = None, tensors: bool = False
) -> DataFrame:
    """One row per batch with an array per column, in row order.

    A batch has a bounded number of rows, so its arrays are bounded too. With
    ``tensors`` the model columns become ``array<float>``.
    """
    names = list(columns or [c for c in batched.columns if c not in (BATCH_ID, ROW_ID, "shard")])
    floats = set(model_columns(batched)) if tensors else set()
    values = [
        F.col(c).cast("float").alias(c) if c in floats else F.col(c) for c in names
    ]
    keys = [c for c in ("shard", BATCH_ID) if c in batched.columns]
    grouped = batched.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col(ROW_ID), F.struct(*values).alias("v")))).alias(
            "__rows"
        )
    )
    return grouped.select(*keys, *[F.col("__rows")["v"][c].alias(c) for c in names])


def iterate_batches(columnar: DataFrame) -> Iterator[dict[str, list]]:
    """Batches in order, one dict of lists at a time, for a local consumer."""
    keys = [c for c in ("shard", BATCH_ID) if c in columnar.columns]
    for row in columnar.orderBy(*keys).toLocalIterator(prefetchPartitions=True):
        batch = row.asDict()
        yield {name: values for name, values in batch.items() if name not in keys}


def with_feature_vector(
    df: DataFrame, name: str = "features", columns: Sequence[str] | None = None, ml: bool = False
) -> DataFrame:
    """Add the model columns as ``array<float>``, or as an ML vector."""
    cols = list(columns or model_columns(df))
    array = F.array(*[F.col(c).cast("float") for c in cols])
    return df.withColumn(name, array_to_vector(array.cast("array<double>")) if ml else array)
