"""Read the speech table from files and directories.

All readers return a lazy DataFrame with dot-free column names, missing numbers as
NULL and, for text formats, the types of the speech schema.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from rostrum.functions.parsing import parse_number
from rostrum.schema import STORED_SCHEMA, nan_to_null, spark_name, to_spark_names

SUFFIX_FORMATS = {
    ".parquet": "parquet",
    ".csv": "csv",
    ".csv.gz": "csv",
    ".jsonl": "json",
    ".jsonl.gz": "json",
    ".json": "json",
}
CSV_OPTIONS = {
    "header": "true",
    "multiLine": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}
# Where the parts of a published data set lie below its root.
SPLIT_PATTERNS = {"train": "*.parquet", "validation": "validation/*.parquet", "test": "test/*.parquet"}


def format_of(path: str) -> str:
    """Format by suffix; anything unknown is an error."""
    name = path.rstrip("/").lower()
    for suffix in sorted(SUFFIX_FORMATS, key=len, reverse=True):
        if name.endswith(suffix):
            return SUFFIX_FORMATS[suffix]
    raise ValueError(f"unsupported source format: {path}")


def _typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast text columns to the declared types; bad values become NULL."""
    declared = {f.name: f.dataType for f in schema.fields}
    columns = []
    for field in df.schema.fields:
        target = declared.get(field.name)
        column = F.col(field.name)
        if target is None or target == field.dataType:
            columns.append(column)
            continue
        if isinstance(target, T.StringType):
            column = column.cast("string")
        elif isinstance(target, T.NumericType):
            # A value that is a number but does not fit the type stays out, too.
            column = parse_number(column).try_cast(target)
        else:
            column = column.try_cast(target)
        columns.append(column.alias(field.name, metadata=field.metadata))
    return df.select(*columns)


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return nan_to_null(to_spark_names(reader.parquet(path)))


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType = STORED_SCHEMA, multi_line: bool = True
) -> DataFrame:
    """CSV with a header; columns are matched by name and cast leniently.

    Columns outside ``schema`` get the type their values have, which takes a pass of its
    own if there are any. Texts may hold line breaks, so a file is read as a whole by one
    task. Large corpora come as many files, or are converted to Parquet once; files known
    to have no quoted line breaks can be split with ``multi_line=False``.
    """
    # With a mark for missing fields, a quoted empty text stays '' and is not NULL.
    options = {**CSV_OPTIONS, "multiLine": str(multi_line).lower(), "nullValue": "\x01"}
    raw = to_spark_names(spark.read.options(**options).csv(path))
    declared = list(schema.fields)
    if set(raw.columns) - set(schema.names):
        # An empty field says nothing about the type of its column.
        options["nullValue"] = ""
        found = to_spark_names(spark.read.options(**options, inferSchema=True).csv(path)).schema
        declared += [f for f in found.fields if f.name not in schema.names]
    return nan_to_null(_typed(raw, T.StructType(declared)))


def read_json_lines(
    spark: SparkSession, path: str, schema: T.StructType = STORED_SCHEMA
) -> DataFrame:
    """JSON lines with published or dot-free names, also with the token NaN.

    One pass finds the columns. Those of ``schema`` get its types, whatever was inferred;
    all others keep the type that was inferred.
    """
    raw = spark.read.json(path)
    # Published and dot-free names of one column may both occur, in different rows.
    written: dict[str, list[str]] = {}
    for name in raw.columns:
        written.setdefault(spark_name(name), []).append(name)
    columns = []
    for name, given in written.items():
        dotted = [g for g in given if g != name]
        metadata = {"published_name": dotted[0]} if dotted else {}
        merged = F.coalesce(*[F.col(f"`{g}`") for g in given])
        columns.append(merged.alias(name, metadata=metadata))
    return nan_to_null(_typed(raw.select(*columns), schema))


def read_corpus(
    spark: SparkSession,
    path: str,
    format: str | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Read a file or directory; the format is given or follows from the suffix."""
    kind = format or format_of(path)
    if kind == "parquet":
        return read_parquet(spark, path, schema)
    if kind == "csv":
        return read_csv(spark, path, schema or STORED_SCHEMA)
    if kind == "json":
        return read_json_lines(spark, path, schema or STORED_SCHEMA)
    raise ValueError(f"unsupported source format: {kind}")


def read_split(spark: SparkSession, root: str, split: str) -> DataFrame:
    """One part of a published data set mirrored below ``root``."""
    if split not in SPLIT_PATTERNS:
        raise ValueError(f"unknown split {split!r}, use one of {sorted(SPLIT_PATTERNS)}")
    return read_parquet(spark, f"{root.rstrip('/')}/{SPLIT_PATTERNS[split]}")


def load_splits(
    spark: SparkSession, root: str, prepare: Callable[[DataFrame], DataFrame] | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train, validation and test, each after ``prepare`` (filters, columns, features)."""
    parts = (read_split(spark, root, s) for s in SPLIT_PATTERNS)
    train, validation, test = (p if prepare is None else prepare(p) for p in parts)
    return train, validation, test


def read_splits(spark: SparkSession, root: str) -> DataFrame:
    """All parts as one table with a ``split`` column."""
    parts = [
        read_split(spark, root, s).withColumn("split", F.lit(s)) for s in SPLIT_PATTERNS
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def _root_path(spark: SparkSession, directory: str) -> str:
    """Path of a directory without scheme and host."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(directory)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(target).toUri().getRawPath().rstrip("/")


def shard_name(spark: SparkSession, directory: str, path: Column) -> Column:
    """Path of a file relative to the directory of the shards: unique, and in their order."""
    root = _root_path(spark, directory)
    plain = F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    below = F.substring(plain, F.lit(len(root) + 2), F.length(plain))
    return F.when(plain.startswith(f"{root}/"), below).otherwise(plain)


def list_shards(spark: SparkSession, directory: str) -> DataFrame:
    """``(path, shard, bytes)`` of the Parquet files below a directory; none is an error."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", "true")
        .load(directory)
        .select(
            "path",
            shard_name(spark, directory, F.col("path")).alias("shard"),
            F.col("length").alias("bytes"),
        )
    )
    if files.isEmpty():
        raise ValueError(f"no parquet files found in {directory}")
    return files


def _tagged(
    spark: SparkSession,
    directory: str,
    schema: T.StructType | None,
    options: Mapping[str, str] | None,
) -> DataFrame:
    reader = spark.read.option("pathGlobFilter", "*.parquet")
    if schema is not None:
        reader = reader.schema(schema)
    raw = reader.options(**(options or {})).parquet(directory)
    return raw.select("*", shard_name(spark, directory, F.col("_metadata.file_path")).alias("shard"))


def damaged_shards(
    spark: SparkSession,
    directory: str,
    schema: T.StructType | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """``(shard, bytes, rows, readable)`` of the shards that cannot be read to their end.

    Each file's rows by its footer are compared with the rows that all of its columns
    give, in one pass over the shards; a file without a footer has no ``rows``.
    """
    lenient = _tagged(spark, directory, schema, {**(options or {}), "ignoreCorruptFiles": "true"})
    stored = lenient.groupBy("shard").agg(F.count("*").alias("rows"))
    columns = [F.col(f"`{c}`") for c in lenient.columns if c != "shard"]
    # A condition on all values: a plain count would be taken from the footers again.
    all_read = F.xxhash64(*columns) != F.lit(0x5DEECE66D)
    read = lenient.groupBy("shard").agg(F.count_if(all_read).alias("readable"))
    listed = list_shards(spark, directory).select("shard", "bytes")
    counted = listed.join(stored, "shard", "left").join(read, "shard", "left")
    readable = F.coalesce("readable", F.lit(0))
    return counted.withColumn("readable", readable).filter(
        F.col("rows").isNull() | (F.col("rows") != F.col("readable"))
    )


def read_shards(
    spark: SparkSession,
    directory: str,
    schema: T.StructType | None = None,
    skip_corrupt: bool = True,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """All shards of a directory with a ``shard`` column, their path below it.

    A shard that cannot be read to its end is left out as a whole; a pass over the shards
    finds out first, and :func:`damaged_shards` lists them. Without ``skip_corrupt`` there
    is no such pass, and reading one fails.
    """
    if not skip_corrupt:
        return nan_to_null(to_spark_names(_tagged(spark, directory, schema, options)))
    bad = [r["shard"] for r in damaged_shards(spark, directory, schema, options).select("shard").collect()]
    lenient = {**(options or {}), "ignoreCorruptFiles": "true"} if bad else options
    shards = _tagged(spark, directory, schema, lenient)
    kept = shards.filter(~F.col("shard").isin(bad)) if bad else shards
    return nan_to_null(to_spark_names(kept))


def shard_order(
    spark: SparkSession, directory: str, shuffle: bool = False, seed: int = 42
) -> DataFrame:
    """``(shard, position)``: shards by name, or in a seeded shuffled order."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), "shard")) if shuffle else F.col("shard")
    # One row per file; the window has no rows of data.
    place = F.row_number().over(Window.orderBy(order, "shard")) - 1
    return list_shards(spark, directory).select("shard", place.cast("long").alias("position"))


def require_non_empty(df: DataFrame, what: str = "table") -> DataFrame:
    """Raise if there is no row. Runs a job, so it is never implied by a reader."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty after loading and filtering")
    return df


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if spark_name(n) not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df
