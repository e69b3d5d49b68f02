"""Rows by position from stored shards: a sparse index tells which files to open.

The index has one row per file: its first position, rows, and first and last key, in the
order of the files' names, and lies beside the shards. It is made from the files' footers
and one narrow column. A look-up reads the index, opens the files that hold the wanted
positions and no others, and takes the rows at their places in them: no wide row is
shuffled, sorted or numbered. Positions follow the order of names and the order of rows in
a file, so shards written in key order (``writers.write_shards``) are looked up in key order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from rostrum.operators.numbering import ROW_ID
from rostrum.schema import nan_to_null, to_spark_names
from rostrum.session import delete_path, path_exists
from rostrum.sources.readers import shard_name

# Spark's readers skip folders with this first letter when they list shards.
INDEX_FOLDER = "_positions"


def index_path(directory: str) -> str:
    return f"{directory.rstrip('/')}/{INDEX_FOLDER}"


def build_index(spark: SparkSession, directory: str, key: str = "doc_id") -> PositionIndex:
    """Write the index of the Parquet shards of a directory and return it.

    Build it anew after shards are added, replaced or removed. ``key`` may be any column; its
    first and last value in each file serve :meth:`PositionIndex.at_keys`.
    """
    shards = spark.read.option("pathGlobFilter", "*.parquet").parquet(directory)
    place = shards.metadataColumn("_metadata")
    entries = shards.select(
        place["file_path"].alias("path"),
        place["file_size"].alias("bytes"),
        F.col(f"`{key}`").cast("string").alias("key"),
    )
    files = entries.groupBy("path", "bytes").agg(
        F.count("*").alias("rows"), F.min("key").alias("first_key"), F.max("key").alias("last_key")
    )
    named = files.withColumn("shard", shard_name(spark, directory, F.col("path")))
    # One row per file; the window has no rows of data.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first")
    target = index_path(directory)
    delete_path(spark, target)
    named.select("shard", "path", first, "rows", "first_key", "last_key", "bytes").write.parquet(target)
    return PositionIndex(spark, directory)


@dataclass(frozen=True)
class PositionIndex:
    """Look-ups over indexed shards; results have ``row_id`` and the shards' columns."""

    spark: SparkSession
    directory: str

    def __post_init__(self) -> None:
        if not path_exists(self.spark, index_path(self.directory)):
            raise ValueError(f"no index beside the shards of {self.directory}, build one first")

    @property
    def entries(self) -> DataFrame:
        """``shard, path, first, rows, first_key, last_key, bytes`` of every file."""
        return self.spark.read.parquet(index_path(self.directory))

    def count(self) -> int:
        """Rows of all shards, from the index."""
        return int(self.entries.agg(F.sum("rows")).first()[0] or 0)

    def _schema(self) -> T.StructType:
        return self.spark.read.option("pathGlobFilter", "*.parquet").parquet(self.directory).schema

    def _rows(self, files: list) -> DataFrame:
        """The rows of some files, with their positions. A file that is not as it was raises."""
        schema = self._schema()
        if not files:
            empty = self.spark.createDataFrame([], schema)
            return nan_to_null(to_spark_names(empty.withColumn(ROW_ID, F.lit(0).cast("long"))))
        raw = self.spark.read.schema(schema).parquet(*[f["path"] for f in files])
        place = raw.metadataColumn("_metadata")
        told = self.spark.createDataFrame(
            [(f["path"], f["first"], f["bytes"]) for f in files], "__path string, __first long, __bytes long"
        )
        # One row per opened file, whose names the reader holds on the driver as well.
        located = raw.withColumns(
            {"__path": place["file_path"], "__row": place["row_index"], "__size": place["file_size"]}
        ).join(F.broadcast(told), "__path")
        changed = F.raise_error(F.concat(F.lit("shard changed since it was indexed: "), "__path")).cast("long")
        position = F.when(F.col("__size") == F.col("__bytes"), F.col("__first") + F.col("__row")).otherwise(changed)
        plain = located.withColumn(ROW_ID, position).drop("__path", "__row", "__size", "__first", "__bytes")
        return nan_to_null(to_spark_names(plain))

    def files_of(self, positions: Sequence[int]) -> list:
        """Index entries of the files that hold the positions; as many as these at most."""
        wanted = self.spark.createDataFrame([(int(p),) for p in sorted(set(positions))], "position long")
        largest = self.entries.agg(F.max("rows")).first()[0] or 1
        # Files by cells of the largest file's rows: each lies in two cells at most.
        cell = F.floor(F.col("position") / largest)
        low, high = (F.floor(p / largest) for p in (F.col("first"), F.col("first") + F.col("rows") - 1))
        held = self.entries.filter("rows > 0").withColumn("cell", F.explode(F.sequence(low, high)))
        met = held.join(F.broadcast(wanted.withColumn("cell", cell)), "cell")
        met = met.filter("position >= first AND position < first + rows")
        return met.select("shard", "path", "first", "bytes").distinct().orderBy("first").collect()

    def rows_at(self, positions: int | slice | Sequence[int]) -> DataFrame:
        """Rows by position: a number, a slice or a list as in Python, negative from the end.

        A position that the shards do not have raises. A list gives its rows in its order, a
        repeated position its row again; a slice gives its rows in no order. A slice over
        many files lists these on the driver, as any read of them does.
        """
        if isinstance(positions, bool) or not isinstance(positions, (int, slice, list, tuple)):
            raise TypeError(f"invalid index type: {type(positions).__name__}")
        total = self.count()
        if isinstance(positions, slice):
            chosen = range(*positions.indices(total))
            if not chosen:
                return self._rows([])
            low, high = min(chosen[0], chosen[-1]), max(chosen[0], chosen[-1])
            held = self.entries.filter((F.col("first") <= high) & (F.col("first") + F.col("rows") > low))
            found = self._rows(held.select("path", "first", "bytes").collect())
            step = F.pmod(F.col(ROW_ID) - chosen[0], F.lit(abs(chosen.step)))
            return found.filter(F.col(ROW_ID).between(low, high) & (step == 0))
        listed = [positions] if isinstance(positions, int) else list(positions)
        outside = [p for p in listed if not -total <= p < total]
        if outside:
            raise IndexError(f"no rows at positions {outside[:10]}, the shards have {total}")
        places = [(i, p + total if p < 0 else p) for i, p in enumerate(listed)]
        if not places:
            return self._rows([])
        found = self._rows(self.files_of([p for _, p in places]))
        wanted = self.spark.createDataFrame(places, f"__place long, {ROW_ID} long")
        return found.join(F.broadcast(wanted), ROW_ID).orderBy("__place").select(found.columns)

    def at_keys(self, keys: Sequence[str], key: str = "doc_id") -> DataFrame:
        """Rows with the given keys, from the files whose keys reach around one of them."""
        if not keys:
            return self._rows([])
        wanted = [str(k) for k in keys]
        near = (F.col("first_key") <= max(wanted)) & (F.col("last_key") >= min(wanted))
        listed = F.array(*[F.lit(k) for k in wanted])
        within = F.exists(listed, lambda k: k.between(F.col("first_key"), F.col("last_key")))
        files = self.entries.filter(near & within).select("path", "first", "bytes").collect()
        return self._rows(files).filter(F.col(f"`{key}`").cast("string").isin(wanted))
