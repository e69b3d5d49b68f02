"""Shards read whole, in order, in one pass: a data source with a partition per shard.

A partition is one shard, at its place in the order asked for (by name, or shuffled by a
seed), so a consumer that takes partitions one after another (``toLocalIterator``) gets the
shards in that order without a sort or a shuffle. A shard is decoded to its end before its
first row leaves the task: a damaged one gives none of its rows, but a single row that tells
what is wrong, and no pass beforehand has to find out. Small shards are kept while they are
decoded; larger ones are decoded a second time for their rows, which bounds a task's memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from rostrum.schema import nan_to_null, to_spark_names
from rostrum.session import filesystem_uri

FORMAT = "rostrum_shards"
# A decoded shard of at most this size is kept, so that it is decoded once.
HOLD_BYTES = 256 << 20
# Columns that the source adds. ``damage`` is missing but for the one row of a damaged shard.
_ADDED = T.StructType().add("shard", "string").add("position", "long").add("damage", "string")


def _listed(directory: str) -> tuple[pyarrow.fs.FileSystem, str, list[str]]:
    files, root = pyarrow.fs.FileSystem.from_uri(directory)
    root = root.rstrip("/")
    found = files.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
    names = (f.path[len(root) + 1 :] for f in found if f.type == pyarrow.fs.FileType.File)
    hidden = ("_", ".")
    shards = [n for n in names if n.endswith(".parquet") and not any(p.startswith(hidden) for p in n.split("/"))]
    return files, root, sorted(shards)


def ordered(shards: list[str], shuffle: bool, seed: int) -> list[str]:
    """Shards by name, or by the hash of seed and name, as ``readers.shard_order`` has them."""
    if not shuffle:
        return sorted(shards)
    return sorted(shards, key=lambda s: (hashlib.md5(f"{seed}:{s}".encode()).hexdigest(), s))


def _decoded(files: pyarrow.fs.FileSystem, path: str) -> Iterator[pa.RecordBatch]:
    with files.open_input_file(path) as source:
        yield from pq.ParquetFile(source).iter_batches()


class ShardReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema = schema
        self.directory = options["path"]
        self.shuffle = options.get("shuffle", "false").lower() == "true"
        self.seed = int(options.get("seed", "42"))
        self.hold = int(options.get("hold_bytes", str(HOLD_BYTES)))

    def partitions(self) -> list[InputPartition]:
        _, _, shards = _listed(self.directory)
        return [InputPartition((k, s)) for k, s in enumerate(ordered(shards, self.shuffle, self.seed))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        position, shard = partition.value
        files, root = pyarrow.fs.FileSystem.from_uri(self.directory)
        path = f"{root.rstrip('/')}/{shard}"
        wanted = to_arrow_schema(self.schema)
        held: list[pa.RecordBatch] | None = []
        size = 0
        try:
            for batch in _decoded(files, path):
                ready = self._shaped(batch, wanted, shard, position)
                size += ready.nbytes
                if held is not None:
                    held.append(ready)
                if size > self.hold:
                    held = None
        except (OSError, pa.ArrowException) as error:
            yield self._marker(wanted, shard, position, f"{type(error).__name__}: {error}"[:500])
            return
        if held is not None:
            yield from held
            return
        for batch in _decoded(files, path):
            yield self._shaped(batch, wanted, shard, position)

    @staticmethod
    def _shaped(batch: pa.RecordBatch, wanted: pa.Schema, shard: str, position: int) -> pa.RecordBatch:
        added = {"shard": shard, "position": position, "damage": None}
        columns = []
        for field in wanted:
            if field.name in added:
                columns.append(pa.repeat(pa.scalar(added[field.name], field.type), batch.num_rows))
            elif field.name in batch.schema.names:
                columns.append(pc.cast(batch.column(field.name), field.type))
            else:
                columns.append(pa.nulls(batch.num_rows, field.type))
        return pa.RecordBatch.from_arrays(columns, schema=wanted)

    @staticmethod
    def _marker(wanted: pa.Schema, shard: str, position: int, damage: str) -> pa.RecordBatch:
        known = {"shard": shard, "position": position, "damage": damage}
        return pa.RecordBatch.from_arrays([pa.array([known.get(f.name)], f.type) for f in wanted], schema=wanted)


class ShardSource(DataSource):
    """``spark.read.format("rostrum_shards")``; options ``path``, ``shuffle``, ``seed``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        """Columns of the first shard whose footer can be read, and those the source adds."""
        files, root, shards = _listed(self.options["path"])
        for shard in shards:
            try:
                with files.open_input_file(f"{root}/{shard}") as source:
                    found = from_arrow_schema(pq.ParquetFile(source).schema_arrow)
            except (OSError, pa.ArrowException):
                continue
            return T.StructType([*found.fields, *_ADDED.fields])
        raise ValueError(f"no readable parquet files found in {self.options['path']}")

    def reader(self, schema: T.StructType) -> ShardReader:
        return ShardReader(schema, dict(self.options))


def read_in_order(
    spark: SparkSession,
    directory: str,
    schema: T.StructType | None = None,
    shuffle: bool = False,
    seed: int = 42,
    hold_bytes: int = HOLD_BYTES,
) -> DataFrame:
    """All shards with ``shard``, ``position`` and ``damage``, a partition per shard in order.

    A damaged shard has one row, with ``damage`` and no value of its columns; filter for
    ``damage IS NULL`` to leave it out, for the opposite to list it. A directory without a
    Parquet file raises. ``schema`` names the columns to read; a shard without one of them
    has no value there.
    """
    spark.dataSource.register(ShardSource)
    uri = filesystem_uri(spark, directory)
    if not _listed(uri)[2]:
        raise ValueError(f"no parquet files found in {directory}")
    options = {"shuffle": str(shuffle).lower(), "seed": str(seed), "hold_bytes": str(hold_bytes)}
    reader = spark.read.format(FORMAT).options(**options)
    if schema is not None:
        reader = reader.schema(T.StructType([*schema.fields, *_ADDED.fields]))
    return nan_to_null(to_spark_names(reader.load(uri)))


def batches_in_order(
    shards: DataFrame, batch_size: int = 32, shuffle: bool = True, seed: int = 42, key: str = "doc_id"
) -> DataFrame:
    """The sound rows of :func:`read_in_order` with ``batch_id`` and ``row_id`` in their shard.

    Rows are shuffled inside their shard by a hash of seed and key, or keep their order.
    A partition stays one shard and its rows leave it in order, so a batch never crosses
    shards and ``toLocalIterator`` gives the batches one after another. The task of a shard
    holds its rows, as their number is the writer's choice.
    """
    sound = shards.filter("damage IS NULL").drop("damage")
    fields = [*sound.schema.fields, T.StructField("batch_id", T.LongType()), T.StructField("row_id", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        if shuffle:
            keys = ["" if k is None else str(k) for k in rows[key].to_pylist()]
            hashes = [hashlib.md5(f"{seed}:{k}".encode()).hexdigest() for k in keys]
            order = sorted(range(len(keys)), key=lambda i: (hashes[i], keys[i]))
            rows = rows.take(pa.array(order))
        row = np.arange(len(rows))
        rows = rows.append_column("batch_id", pa.array(row // batch_size)).append_column("row_id", pa.array(row))
        yield from rows.combine_chunks().to_batches()

    return sound.mapInArrow(run, T.StructType(fields))


def iterate_shard_batches(batches: DataFrame) -> Iterator[dict[str, list]]:
    """Columnar batches, shard after shard, from :func:`batches_in_order`.

    The driver holds one shard at a time and the next one is read meanwhile.
    """
    held: list = []
    for row in batches.toLocalIterator(prefetchPartitions=True):
        if held and (row["position"], row["batch_id"]) != (held[0]["position"], held[0]["batch_id"]):
            yield {c: [r[c] for r in held] for c in batches.columns}
            held = []
        held.append(row)
    if held:
        yield {c: [r[c] for r in held] for c in batches.columns}


def damage_of(shards: DataFrame) -> DataFrame:
    """``shard, position, damage`` of the damaged shards."""
    return shards.filter(F.col("damage").isNotNull()).select("shard", "position", "damage")
