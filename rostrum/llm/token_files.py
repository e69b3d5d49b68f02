"""Token ids in Parquet files: ascending documents, delta encoding, small row groups.

The texts are range-partitioned by document id, encoded where they arrive and written by
Spark's own Parquet writer: list columns of 32-bit ids with the version 2 pages' delta
encoding (or a dictionary), row groups and pages of a chosen size, and the column and
offset indexes the writer adds to every file. A reader that wants a few documents or only
the counts touches only those pages and columns.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rostrum.llm.common import sliced, table, text_bytes
from rostrum.llm.registry import query
from rostrum.llm.tokens import ENCODE_BYTES, encoder, vocabulary_path
from rostrum.session import scratch_path

# Text of one file, and of one Parquet row group and page within it.
FILE_BYTES = 64 << 20
ROW_GROUP_BYTES = 8 << 20
PAGE_BYTES = 256 << 10


def write_token_files(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    end_id: int | None = 1,
    key: str = "doc_id",
    text: str = "text",
    encoding: str = "delta",
    file_bytes: int = FILE_BYTES,
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
    words: bool = True,
) -> None:
    """Encode all texts and write them below ``path``, ascending by ``key``.

    Columns: ``key``, ``part`` (number of the file in key order), ``local_start`` (ids
    before the row in its file), ``n_tokens``, ``tokens``. A missing text counts as
    empty, a missing key comes first; rows with equal keys are ordered by text hash and
    then by place of reading, so frequent keys spread over files. Other columns of
    ``docs`` are not read. An empty table gives files without rows.
    """
    if encoding not in ("delta", "dictionary"):
        raise ValueError(f"unknown encoding {encoding!r}")
    rows = docs.select(
        F.col(f"`{key}`").alias("key"),
        F.col(f"`{text}`").alias("text"),
        F.monotonically_increasing_id().alias("place"),
    ).withColumn("tie", F.xxhash64("text"))
    files = max(1, -(-text_bytes(docs, text) // file_bytes))
    order = ["key", "tie", "place"]
    placed = rows.repartitionByRange(files, *order).sortWithinPartitions(*order)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in sliced(batches, "text", ENCODE_BYTES):
            ids, ends = encoder(vocabulary, words).encode(batch.column("text"), end_id)
            counts = np.diff(ends, prepend=0)
            yield pa.record_batch(
                {
                    "key": batch.column("key"),
                    "part": pa.array(np.full(len(ends), part, dtype=np.int32)),
                    "local_start": pa.array(before + ends - counts),
                    "n_tokens": pa.array(counts),
                    "tokens": pa.ListArray.from_arrays(
                        pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids)
                    ),
                }
            )
            before += int(ends[-1])

    kind = docs.select(F.col(f"`{key}`")).schema[0].dataType.simpleString()
    encoded = placed.select("key", "text").mapInArrow(
        encode, f"key {kind}, part int, local_start long, n_tokens long, tokens array<int>"
    )
    (
        encoded.withColumnRenamed("key", key)
        .write.option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("compression", "zstd")
        .parquet(path)
    )


def read_token_files(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Rows of :func:`write_token_files` with ``start``: ids of all rows before.

    The sums per file read two narrow columns; one row per file is broadcast.
    """
    rows = spark.read.parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return rows.join(F.broadcast(offsets), "part").select(
        f"`{key}`", (F.col("offset") + F.col("local_start")).alias("start"), "n_tokens", "tokens"
    )


def id_checksums(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """crc32 of each row's ids as little-endian unsigned 32-bit integers."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            ids = np.ascontiguousarray(lists.flatten().to_numpy(), dtype="<u4").view(np.uint8)
            ends = np.cumsum(batch.column("n_tokens").to_numpy(), dtype=np.int64) * 4
            begins = np.append(0, ends)[:-1]
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            yield pa.record_batch(
                {
                    "key": batch.column(key),
                    "start": batch.column("start"),
                    "n_tokens": batch.column("n_tokens"),
                    "ids_crc32": pa.array(sums, type=pa.int64()),
                }
            )

    kind = rows.select(F.col(f"`{key}`")).schema[0].dataType.simpleString()
    summed = rows.mapInArrow(crc, f"key {kind}, start long, n_tokens long, ids_crc32 long")
    return summed.withColumnRenamed("key", key)


@query("op8_token_files")
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written as Parquet in ascending doc_id order, read back."""
    path = scratch_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, vocabulary_path())
    return id_checksums(read_token_files(spark, path))
