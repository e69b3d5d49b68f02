"""Write the speech table: Parquet, CSV, JSON lines, shards, Arrow, filters, reports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T

from rostrum.functions.predicates import FilterSpec, standard_filters
from rostrum.operators.numbering import ROW_ID, number_by_key, part_offsets, place_by_key
from rostrum.operators.select import merged_filters
from rostrum.schema import to_published_names
from rostrum.session import (
    delete_path,
    discard,
    filesystem_uri,
    list_below,
    list_paths,
    make_folder,
    materialize,
    move_path,
    move_paths,
    path_exists,
    scratch_path,
)
from rostrum.sources.readers import SPLIT_PATTERNS

SHARD_ROWS = 50_000
MEBIBYTE = 1024**2

# Fixed value: largest change a float may suffer when it is stored in 32 bits.
FLOAT_TOLERANCE = 5e-4
_INTEGERS = (
    (T.ByteType(), -(2**7), 2**7 - 1),
    (T.ShortType(), -(2**15), 2**15 - 1),
    (T.IntegerType(), -(2**31), 2**31 - 1),
)


# ---- sizes ------------------------------------------------------------------------


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Length of all data files below a path, on any Hadoop file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(target).getLength()


def _written(spark: SparkSession, path: str, compression: str) -> dict:
    size = stored_bytes(spark, path)
    return {
        "file_path": path,
        "size_bytes": size,
        "size_mb": size / MEBIBYTE,
        "compression": compression,
    }


def compare_sizes(results: Mapping[str, Mapping], baseline: str = "compressed_csv") -> list[dict]:
    """Size per format and percent saved against the baseline, one decimal."""
    base = results.get(baseline, {}).get("size_bytes")
    rows = []
    for name, result in results.items():
        if "compression" not in result:
            continue
        saved = None
        if base and name != baseline:
            saved = round((1 - result["size_bytes"] / base) * 100, 1)
        rows.append(
            {
                "format": name,
                "size_mb": result["size_mb"],
                "compression": result["compression"],
                "savings_vs_csv_percent": saved,
            }
        )
    return rows


# ---- single formats -----------------------------------------------------------------


def narrowing_profile(df: DataFrame) -> DataFrame:
    """One row with the range of each integer and the float error of each double column."""
    aggregates = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.IntegralType):
            aggregates += [F.min(c).alias(f"{f.name}__min"), F.max(c).alias(f"{f.name}__max")]
        elif isinstance(f.dataType, T.DoubleType):
            error = F.max(F.abs(c - c.cast("float").cast("double")))
            aggregates.append(error.alias(f"{f.name}__error"))
    return df.agg(*aggregates) if aggregates else df.limit(0)


def narrowed_types(df: DataFrame) -> dict[str, T.DataType]:
    """Smallest lossless integer and tolerable float type per column (one scan)."""
    profile: Row | None = narrowing_profile(df).first()
    types: dict[str, T.DataType] = {}
    for f in df.schema.fields:
        types[f.name] = f.dataType
        if profile is None:
            continue
        if isinstance(f.dataType, T.IntegralType):
            low, high = profile[f"{f.name}__min"], profile[f"{f.name}__max"]
            if low is None:
                continue
            for candidate, least, greatest in _INTEGERS:
                if least <= low and high <= greatest:
                    types[f.name] = candidate
                    break
        elif isinstance(f.dataType, T.DoubleType):
            error = profile[f"{f.name}__error"]
            if error is not None and error <= FLOAT_TOLERANCE:
                types[f.name] = T.FloatType()
    return types


def narrow_types(df: DataFrame) -> DataFrame:
    """Cast numbers to the narrowest type that holds them; Parquet encodes text itself."""
    types = narrowed_types(df)
    return df.select(
        *[
            F.col(f.name).cast(types[f.name]).alias(f.name, metadata=f.metadata)
            if types[f.name] != f.dataType
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def write_parquet(
    df: DataFrame, path: str, narrow: bool = True, partition_by: Sequence[str] = ()
) -> dict:
    """Snappy Parquet, by default after narrowing the types."""
    stored = narrow_types(df) if narrow else df
    writer = stored.write.mode("overwrite").option("compression", "snappy")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return _written(df.sparkSession, path, "snappy")


def write_csv(df: DataFrame, path: str, published_names: bool = False) -> dict:
    """Gzip CSV with header; line breaks and quotes in texts survive."""
    stored = to_published_names(df) if published_names else df
    (
        stored.write.mode("overwrite")
        .options(
            header=True,
            compression="gzip",
            quote='"',
            escape='"',
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
        )
        .csv(path)
    )
    return _written(df.sparkSession, path, "gzip")


def write_json_lines(df: DataFrame, path: str, published_names: bool = False) -> dict:
    """Gzip JSON lines, one object per row, missing values as null."""
    stored = to_published_names(df) if published_names else df
    writer = stored.write.mode("overwrite").option("compression", "gzip")
    writer.option("ignoreNullFields", False).json(path)
    return _written(df.sparkSession, path, "gzip")


# ---- shards ---------------------------------------------------------------------------


def with_shards(df: DataFrame, shard_rows: int = SHARD_ROWS, key: str = "doc_id") -> DataFrame:
    """Add ``row_id`` and ``shard_id``: consecutive rows in key order, all but the
    last shard full."""
    numbered = number_by_key(df, [key])
    return numbered.withColumn("shard_id", F.floor(F.col(ROW_ID) / shard_rows).cast("long"))


def write_shards(
    df: DataFrame, path: str, shard_rows: int = SHARD_ROWS, key: str = "doc_id"
) -> dict:
    """One file per shard of exactly ``shard_rows`` rows, ``shard_0000.parquet`` and on.

    The rows are range-partitioned and stored once for their numbers. Shards that lie in one
    range partition are written from there; the rows of the others, at most two for each
    partition or all where a shard is the larger one, are shuffled by shard. The files are
    then renamed; their list comes back in order.
    """
    placed = place_by_key(df, [key])
    result = _write_placed(placed, df.columns, path, shard_rows)
    discard(placed)
    return result


def _write_placed(placed: DataFrame, columns: Sequence[str], path: str, shard_rows: int) -> dict:
    """Shards of the rows that ``place_by_key`` has stored, each file written by one task."""
    spark = placed.sparkSession
    row, shard, offset = F.col("__offset") + F.col("__pos"), F.col("__shard"), F.col("__offset")
    rows = (
        placed.join(F.broadcast(part_offsets(placed)), "__part")
        .withColumn(ROW_ID, row)
        .withColumn("__shard", F.floor(row / shard_rows).cast("long"))
    )
    whole = (shard * shard_rows >= offset) & ((shard + 1) * shard_rows <= offset + F.col("__n"))

    def write(part: DataFrame) -> dict[int, list[str]]:
        staging = scratch_path(spark, "shards")
        stagings.append(staging)
        ordered = part.sortWithinPartitions("__shard", ROW_ID).select("__shard", *columns)
        ordered.write.option("compression", "snappy").partitionBy("__shard").parquet(staging)
        found: dict[int, list[str]] = {}
        for file in list_below(spark, staging):
            folder, name = file.rsplit("/", 2)[1:]
            if "__shard=" in folder and name.endswith(".parquet"):
                found.setdefault(int(folder.rsplit("=", 1)[1]), []).append(file)
        return found

    stagings: list[str] = []
    files = write(rows.filter(whole))
    files |= write(rows.filter(~whole).repartition("__shard"))
    # A large file of a partition is read by several tasks; a shard at such a border is
    # written again.
    parted = [number for number, found in files.items() if len(found) > 1]
    if parted:
        files |= write(rows.filter(shard.isin(parted)).repartition("__shard"))
    delete_path(spark, path)
    make_folder(spark, path)
    names, moves = [], []
    for number, (file,) in sorted(files.items()):
        names.append(f"shard_{number:04d}.parquet")
        moves.append((file, f"{path.rstrip('/')}/{names[-1]}"))
    move_paths(spark, moves)
    for staging in stagings:
        delete_path(spark, staging)
    size, count = stored_bytes(spark, path), len(names)
    return {
        "shard_directory": path,
        "num_shards": count,
        "shard_files": names,
        "total_size_bytes": size,
        "total_size_mb": size / MEBIBYTE,
        "avg_shard_size_mb": size / count / MEBIBYTE if count else None,
    }


# ---- arrow ------------------------------------------------------------------------------

_ARROW_FILES = "path string, rows bigint, bytes bigint"


def write_arrow(df: DataFrame, path: str) -> DataFrame:
    """Arrow IPC files below ``path``; returns their list ``(path, rows, bytes)``.

    ``path`` is a folder that all executors reach, of Spark's default file system unless it
    has a scheme. The files are written once, now: each task writes the file of its
    partition under a name of its own and renames it when complete. A new folder takes the
    place of ``path`` at the end, so nothing of an earlier run stays. One row per file
    comes back to the driver.
    """
    spark = df.sparkSession
    staging = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    target = filesystem_uri(spark, staging)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        context = TaskContext.get()
        files, root = fs.FileSystem.from_uri(target)
        files.create_dir(root, recursive=True)
        final = f"{root}/part-{context.partitionId():05d}.arrow"
        partial = f"{root}/_{context.partitionId():05d}-{context.taskAttemptId()}.tmp"
        rows, writer = 0, None
        with files.open_output_stream(partial) as sink:
            for batch in batches:
                if writer is None:
                    writer = pa.ipc.new_file(sink, batch.schema)
                writer.write_batch(batch)
                rows += batch.num_rows
            if writer is not None:
                writer.close()
        if writer is None:
            files.delete_file(partial)
            return
        size = files.get_file_info(partial).size
        files.move(partial, final)
        name = final.rsplit("/", 1)[1]
        yield pa.RecordBatch.from_pydict({"path": [name], "rows": [rows], "bytes": [size]})

    manifest = df.mapInArrow(write, _ARROW_FILES).collect()
    make_folder(spark, staging)
    for name in list_paths(spark, staging):
        if name.endswith(".tmp"):
            delete_path(spark, name)
    delete_path(spark, path)
    move_path(spark, staging, path)
    listed = [(f"{path.rstrip('/')}/{r['path']}", r["rows"], r["bytes"]) for r in manifest]
    return spark.createDataFrame(listed, _ARROW_FILES)


# ---- several outputs -----------------------------------------------------------------------


def write_all_formats(
    df: DataFrame,
    path: str,
    create_shards: bool = True,
    shard_rows: int = SHARD_ROWS,
    key: str = "doc_id",
) -> dict:
    """Parquet, CSV, JSON lines and optionally shards, with a size comparison.

    The table is computed and stored once, with shards in the order of the key, which is
    theirs; every format is written from that copy, which then goes.
    """
    root = path.rstrip("/")
    stored = place_by_key(df, [key]) if create_shards else materialize(df, "formats", "zstd")
    table = stored.select(df.columns)
    results = {
        "parquet": write_parquet(table, f"{root}/speeches.parquet"),
        "compressed_csv": write_csv(table, f"{root}/speeches.csv.gz"),
        "jsonlines": write_json_lines(table, f"{root}/speeches.jsonl.gz"),
    }
    if create_shards:
        results["shards"] = _write_placed(stored, df.columns, f"{root}/shards", shard_rows)
    discard(stored)
    results["summary"] = compare_sizes(results)
    return results


def write_filtered(
    df: DataFrame, path: str, custom: Mapping[str, FilterSpec] | None = None
) -> tuple[dict, dict[str, str]]:
    """Every non-empty named filter to ``speeches_<name>.parquet``, in one scan.

    Returns what was written, with each filter's definition, and the filters that failed
    with the reason. A row goes to every filter it passes: the names of its filters are
    exploded and the rows written by name. The sets are counted from what is stored.
    """
    spark = df.sparkSession
    predicates, failed = merged_filters(df, custom)
    definitions = {**standard_filters(df.columns), **(custom or {})}
    names = F.array_compact(F.array(*[F.when(p, F.lit(n)) for n, p in predicates.items()]))
    staging, root = scratch_path(spark, "filtered"), path.rstrip("/")
    df.withColumn("__filter", F.explode(names)).write.partitionBy("__filter").parquet(staging)
    make_folder(spark, root)
    written = {}
    for name in predicates:
        folder = f"{staging}/__filter={name}"
        if not path_exists(spark, folder):
            continue
        target = f"{root}/speeches_{name}.parquet"
        delete_path(spark, target)
        move_path(spark, folder, target)
        written[name] = {
            "documents": spark.read.schema(df.schema).parquet(target).count(),
            "file_path": target,
            "size_mb": stored_bytes(spark, target) / MEBIBYTE,
            "filter": dict(definitions[name]),
        }
    delete_path(spark, staging)
    return written, failed


def write_splits(parted: DataFrame, path: str) -> dict[str, int]:
    """Rows with a ``split`` column into the folders ``readers.read_split`` expects.

    Train lies at the root, the other parts in folders of their own. One scan writes all
    parts; returns the rows of each.
    """
    spark, root = parted.sparkSession, path.rstrip("/")
    staging = scratch_path(spark, "splits")
    parted.write.partitionBy("split").parquet(staging)
    schema = parted.drop("split").schema
    rows = {}
    for split, pattern in SPLIT_PATTERNS.items():
        folder = f"{root}/{pattern.removesuffix('*.parquet')}".rstrip("/")
        make_folder(spark, folder)
        for file in list_paths(spark, folder):
            if file.endswith(".parquet"):
                delete_path(spark, file)
        source = f"{staging}/split={split}"
        files = list_paths(spark, source) if path_exists(spark, source) else []
        for file in files:
            if file.endswith(".parquet"):
                move_path(spark, file, f"{folder}/{file.rsplit('/', 1)[1]}")
        if not files:
            # A part without rows still has its columns.
            empty = scratch_path(spark, "empty")
            spark.createDataFrame([], schema).coalesce(1).write.parquet(empty)
            for file in list_paths(spark, empty):
                if file.endswith(".parquet"):
                    move_path(spark, file, f"{folder}/{file.rsplit('/', 1)[1]}")
            delete_path(spark, empty)
        rows[split] = spark.read.schema(schema).parquet(f"{folder}/*.parquet").count()
    delete_path(spark, staging)
    return rows


def write_report(
    spark: SparkSession,
    path: str,
    history: Sequence[Mapping],
    statistics: Mapping[str, DataFrame],
    info: DataFrame | None = None,
) -> None:
    """Processing history, statistics families and table info as JSON lines."""
    root = path.rstrip("/")
    steps = [(i, json.dumps(dict(step), default=str)) for i, step in enumerate(history)]
    spark.createDataFrame(steps, "step int, entry string").coalesce(1).write.mode(
        "overwrite"
    ).json(f"{root}/history")
    for name, table in statistics.items():
        table.write.mode("overwrite").json(f"{root}/statistics/{name}")
    if info is not None:
        info.write.mode("overwrite").json(f"{root}/info")
