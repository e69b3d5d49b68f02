"""Queries that write the speech view and read it back, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rostrum.corpus import Corpus
from rostrum.operators import cleaning, splits
from rostrum.operators.batches import with_shard_batches
from rostrum.operators.epochs import epoch_batch
from rostrum.operators.features import with_topic_features
from rostrum.operators.positions import build_index
from rostrum.plans.registry import as_double, as_long, query, rounded
from rostrum.plans.selection import STANDARD_COLUMNS, filter_counts_sql
from rostrum.plans.rows import _NUMBERED, _flag_split_sql, epoch_sql
from rostrum.plans.speech_view import (
    SQL_CLEANED,
    SQL_SPEECHES,
    TABLE_SCHEMAS,
    attach,
    speeches,
)
from rostrum.plans.statistics import _BASIC, _tall
from rostrum.plans.topics import FEATURE_SQL, feature_columns
from rostrum.schema import TOPIC_COLUMNS
from rostrum.session import filesystem_uri, is_folder, make_folder, scratch_path
from rostrum.sources import readers, shard_source, writers
from rostrum.streaming import categories, shards as streaming

_ROWS = f"""SELECT doc_id, bonica_rid, bill_id, page_id, md5(text) AS text_md5,
  md5(stemmed_text) AS stemmed_md5, date, congno, legis_body,
  CAST(training_set AS DOUBLE) AS training_set, doc_type,
  {", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in TOPIC_COLUMNS)} FROM speeches"""
_ROUNDTRIP = f"WITH {SQL_SPEECHES} {_ROWS}"


def _rows(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id",
        "bonica_rid",
        "bill_id",
        "page_id",
        F.md5("text").alias("text_md5"),
        F.md5("stemmed_text").alias("stemmed_md5"),
        "date",
        F.col("congno").cast("long").alias("congno"),
        "legis_body",
        F.col("training_set").cast("double").alias("training_set"),
        "doc_type",
        *TOPIC_COLUMNS,
    ).transform(rounded, *TOPIC_COLUMNS)


@query("roundtrip_parquet", _ROUNDTRIP)
def roundtrip_parquet(spark, sf_dir):
    path = scratch_path(spark, "speeches") + ".parquet"
    writers.write_parquet(speeches(spark, sf_dir), path, narrow=False)
    return _rows(readers.read_corpus(spark, path))


@query("roundtrip_csv", _ROUNDTRIP)
def roundtrip_csv(spark, sf_dir):
    path = scratch_path(spark, "speeches") + ".csv.gz"
    writers.write_csv(speeches(spark, sf_dir), path)
    return _rows(readers.read_corpus(spark, path))


@query("roundtrip_jsonl", _ROUNDTRIP)
def roundtrip_jsonl(spark, sf_dir):
    path = scratch_path(spark, "speeches") + ".jsonl.gz"
    writers.write_json_lines(speeches(spark, sf_dir), path)
    return _rows(readers.read_corpus(spark, path))


_FORMATS = {
    "parquet": lambda df, path: writers.write_parquet(df, path, narrow=False),
    "csv": writers.write_csv,
    "json": writers.write_json_lines,
}


def _stored(df: DataFrame, kind: str) -> DataFrame:
    """The table after a round trip through one format."""
    path = scratch_path(df.sparkSession, "cleaned")
    _FORMATS[kind](df, path)
    return readers.read_corpus(df.sparkSession, path, kind)


def _register_round_trips() -> None:
    """Cleaned and featured tables keep the columns they were given, in every format."""
    for kind in _FORMATS:

        @query(f"roundtrip_features_{kind}", FEATURE_SQL)
        def features(spark, sf_dir, kind=kind):
            return feature_columns(_stored(with_topic_features(speeches(spark, sf_dir)), kind))

        @query(f"roundtrip_cleaned_{kind}", _CLEANED_ROWS)
        def cleaned(spark, sf_dir, kind=kind):
            view = speeches(spark, sf_dir, _CLEAN_COLUMNS)
            return _cleaned_rows(_stored(cleaning.clean(view), kind))


@query(
    "export_arrow",
    f"""WITH {SQL_SPEECHES} SELECT doc_id, md5(text) AS text_md5, date, congno, legis_body
FROM speeches""",
)
def export_arrow(spark, sf_dir):
    columns = ["doc_id", "text", "date", "congno", "legis_body"]
    view = speeches(spark, sf_dir, columns)
    path = scratch_path(spark, "arrow")
    files = writers.write_arrow(view.select(columns), path)
    uris = files.select(F.concat(F.lit(filesystem_uri(spark, path)), F.lit("/"), F.element_at(F.split("path", "/"), -1)).alias("uri"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs, ipc

        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                files, name = fs.FileSystem.from_uri(uri)
                with files.open_input_file(name) as source:
                    stored = ipc.open_file(source)
                    for i in range(stored.num_record_batches):
                        yield stored.get_batch(i)

    rows = uris.mapInArrow(read, view.select(columns).schema)
    return rows.select("doc_id", F.md5("text").alias("text_md5"), "date", "congno", "legis_body")


def _integer_type(column: str) -> str:
    fits = [("tinyint", 2**7), ("smallint", 2**15), ("int", 2**31)]
    cases = " ".join(
        f"WHEN min({column}) >= -{bound} AND max({column}) < {bound} THEN '{name}'"
        for name, bound in fits
    )
    return f"CASE {cases} ELSE 'bigint' END"


@query(
    "narrow_types",
    f"WITH {SQL_SPEECHES} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {sql} AS type FROM speeches"
        for c, sql in {
            "congno": _integer_type("congno"),
            "training_set": _integer_type("training_set"),
            **{
                c: f"CASE WHEN max(abs({c} - CAST(CAST({c} AS FLOAT) AS DOUBLE))) <= 5e-4 "
                "THEN 'float' ELSE 'double' END"
                for c in TOPIC_COLUMNS
            },
        }.items()
    ),
)
def narrow_types(spark, sf_dir):
    view = speeches(spark, sf_dir, ["congno", "training_set"], topics=True)
    types = writers.narrowed_types(view)
    # Spark's schema, read back from what is stored, as rows.
    path = scratch_path(spark, "narrow")
    writers.write_parquet(view, path)
    stored = spark.read.parquet(path)
    assert {f.name: f.dataType for f in stored.schema.fields} == types
    row = stored.agg(*[F.first(F.typeof(c)).alias(c) for c in stored.columns])
    return row.unpivot([], stored.columns, "column", "type")


@query(
    "write_formats",
    f"WITH {SQL_SPEECHES} "
    + " UNION ALL ".join(
        f"SELECT '{name}' AS format, CAST(count(*) AS BIGINT) AS documents, "
        "CAST(sum(length(text)) AS BIGINT) AS characters FROM speeches"
        for name in ("parquet", "compressed_csv", "jsonlines", "shards")
    ),
)
def write_formats(spark, sf_dir):
    root = scratch_path(spark, "formats")
    results = writers.write_all_formats(speeches(spark, sf_dir), root, shard_rows=200)
    paths = {
        "parquet": (results["parquet"]["file_path"], "parquet"),
        "compressed_csv": (results["compressed_csv"]["file_path"], "csv"),
        "jsonlines": (results["jsonlines"]["file_path"], "json"),
        "shards": (results["shards"]["shard_directory"], "parquet"),
    }
    counted = [
        readers.read_corpus(spark, path, kind)
        .agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("characters"))
        .withColumn("format", F.lit(name))
        for name, (path, kind) in paths.items()
    ]
    return reduce(DataFrame.unionByName, counted)


@query(
    "shard_files",
    f"""{_NUMBERED}
SELECT CAST(row_id // 300 AS BIGINT) AS shard_id, CAST(1 AS BIGINT) AS files,
  CAST(count(*) AS BIGINT) AS documents, min(doc_id) AS first_id, max(doc_id) AS last_id
FROM numbered GROUP BY 1""",
)
def shard_files(spark, sf_dir):
    path = scratch_path(spark, "shards")
    writers.write_shards(speeches(spark, sf_dir, ["doc_id", "congno"]), path, 300)
    stored = readers.read_shards(spark, path)
    number = F.regexp_extract("shard", "^shard_([0-9]+)[.]parquet$", 1).cast("long")
    return stored.groupBy(number.alias("shard_id")).agg(
        F.count_distinct("shard").alias("files"),
        F.count("*").alias("documents"),
        F.min("doc_id").alias("first_id"),
        F.max("doc_id").alias("last_id"),
    )


@query(
    "filtered_versions",
    f"SELECT * FROM ({filter_counts_sql({})}) WHERE documents > 0 ORDER BY filter_name",
)
def filtered_versions(spark, sf_dir):
    view = speeches(spark, sf_dir, ["doc_id", *STANDARD_COLUMNS])
    written, _ = writers.write_filtered(view, scratch_path(spark, "filtered"))
    counted = [
        spark.read.parquet(entry["file_path"])
        .agg(F.count("*").alias("documents"))
        .withColumn("filter_name", F.lit(name))
        for name, entry in written.items()
    ]
    none = spark.createDataFrame([], "documents long, filter_name string")
    return reduce(DataFrame.unionByName, counted, none)


@query("split_files", _flag_split_sql(100))
def split_files(spark, sf_dir):
    root = scratch_path(spark, "mirror")
    parted = splits.prepare_splits(speeches(spark, sf_dir, ["doc_id", "training_set", "congno"]))
    writers.write_splits(parted, root)
    return readers.read_splits(spark, root).select("doc_id", "split")


# ---- several shards -------------------------------------------------------------------

_SHARDED = f"""{_NUMBERED}, sharded AS (
  SELECT printf('shard_%04d.parquet', CAST(row_id // 150 AS BIGINT)) AS shard, doc_id FROM numbered
), placed AS (
  SELECT shard, doc_id,
    row_number() OVER (PARTITION BY shard ORDER BY md5('42:' || doc_id), doc_id) - 1 AS row_id
  FROM sharded
)
SELECT shard, CAST(row_id // 32 AS BIGINT) AS batch_id, CAST(row_id AS BIGINT) AS row_id, doc_id
FROM placed"""


def _several_shards(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "shards")
    writers.write_shards(speeches(spark, sf_dir, ["doc_id"]).select("doc_id"), path, 150)
    return path


def _damage(spark: SparkSession, path: str) -> None:
    """Overwrite the first bytes of a file."""
    files, name = pyarrow.fs.FileSystem.from_uri(filesystem_uri(spark, path))
    with files.open_input_file(name) as source:
        data = source.read()
    with files.open_output_stream(name) as target:
        target.write(b"\xff" * 64 + data[64:])


@query("shards_read", _SHARDED)
def shards_read(spark, sf_dir):
    return with_shard_batches(readers.read_shards(spark, _several_shards(spark, sf_dir)))


@query("shards_streamed", _SHARDED)
def shards_streamed(spark, sf_dir):
    directory, path = _several_shards(spark, sf_dir), scratch_path(spark, "stream")
    schema = T.StructType.fromDDL("doc_id string")
    lanes = streaming.stream_lanes(spark, directory, schema, files_per_trigger=2)
    runs = [
        streaming.stream_shard_batches(s, f"{path}/rows/lane={k}", f"{path}/checkpoint/lane={k}")
        for k, s in enumerate(lanes)
    ]
    streaming.await_all(runs)
    return spark.read.parquet(f"{path}/rows").drop("lane", "epoch")


@query(
    "shard_positions",
    f"""{_NUMBERED}, named AS (
  SELECT DISTINCT printf('shard_%04d.parquet', CAST(row_id // 150 AS BIGINT)) AS shard FROM numbered
)
SELECT shard, CAST(row_number() OVER (ORDER BY shard) - 1 AS BIGINT) AS position,
  CAST(row_number() OVER (ORDER BY md5('7:' || shard), shard) - 1 AS BIGINT) AS shuffled FROM named""",
)
def shard_positions(spark, sf_dir):
    path = _several_shards(spark, sf_dir)
    shuffled = readers.shard_order(spark, path, shuffle=True, seed=7)
    return readers.shard_order(spark, path).join(
        shuffled.withColumnRenamed("position", "shuffled"), "shard"
    )


@query(
    "shards_damaged",
    f"""{_NUMBERED}, sized AS (
  SELECT CAST(row_id // 150 AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS documents FROM numbered GROUP BY 1
)
SELECT printf('shard_%04d.parquet', n) AS shard, CASE WHEN n = 1 THEN 0 ELSE documents END AS documents,
  n = 1 AS damaged FROM sized""",
)
def shards_damaged(spark, sf_dir):
    """One shard loses its first bytes; it is reported, and none of its rows is read."""
    path = _several_shards(spark, sf_dir)
    _damage(spark, f"{path}/shard_0001.parquet")
    read = readers.read_shards(spark, path).groupBy("shard").agg(F.count("*").alias("documents"))
    bad = readers.damaged_shards(spark, path).select("shard", F.lit(True).alias("bad"))
    listed = readers.list_shards(spark, path).select("shard")
    return listed.join(read, "shard", "left").join(bad, "shard", "left").select(
        "shard",
        F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("bad", F.lit(False)).alias("damaged"),
    )


@query(
    "indexed_lookup",
    f"""{_NUMBERED}
SELECT CAST(row_id AS BIGINT) AS row_id, doc_id, 'slice' AS kind FROM numbered
WHERE row_id >= 10 AND row_id < 180 AND (row_id - 10) % 7 = 0
UNION ALL SELECT CAST(row_id AS BIGINT), doc_id, 'list' FROM numbered JOIN (
  SELECT unnest([0, 3, 3, 149, 150, 199, (SELECT count(*) - 1 FROM speeches)]) AS position
) ON row_id = position
UNION ALL SELECT CAST(row_id AS BIGINT), doc_id, 'single' FROM numbered WHERE row_id = 42""",
)
def indexed_lookup(spark, sf_dir):
    """Rows by position from shards and their index, which names the files to open."""
    index = build_index(spark, _several_shards(spark, sf_dir))
    kinds = {"slice": slice(10, 180, 7), "list": [0, 3, 3, 149, 150, 199, -1], "single": 42}
    found = [index.rows_at(p).select("row_id", "doc_id", F.lit(k).alias("kind")) for k, p in kinds.items()]
    return reduce(DataFrame.unionByName, found)


@query(
    "epoch_lookup",
    f"""{_NUMBERED.replace("WITH", "WITH RECURSIVE", 1)}, {epoch_sql(1)}
SELECT row_id, position, position // 20 AS batch_id, doc_id FROM placed JOIN numbered USING (row_id)
WHERE position // 20 IN (0, 3, (SELECT (n - 1) // 20 FROM size))""",
)
def epoch_lookup(spark, sf_dir):
    """Three batches of an epoch, of which the files that hold their rows are opened."""
    index = build_index(spark, _several_shards(spark, sf_dir))
    wanted = {0, 3, (index.count() - 1) // 20}
    found = [
        epoch_batch(index, k, 20, epoch=1).withColumn("batch_id", F.lit(k).cast("long")) for k in sorted(wanted)
    ]
    return reduce(DataFrame.unionByName, found).select("row_id", "position", "batch_id", "doc_id")


@query(
    "shards_in_order",
    f"""{_NUMBERED}, sharded AS (
  SELECT printf('shard_%04d.parquet', CAST(row_id // 150 AS BIGINT)) AS shard, doc_id FROM numbered
), named AS (
  SELECT shard, row_number() OVER (ORDER BY md5('7:' || shard), shard) - 1 AS position
  FROM (SELECT DISTINCT shard FROM sharded)
), placed AS (
  SELECT shard, doc_id,
    row_number() OVER (PARTITION BY shard ORDER BY md5('7:' || doc_id), doc_id) - 1 AS row_id FROM sharded
)
SELECT shard, CAST(position AS BIGINT) AS position, CAST(position AS BIGINT) AS delivered,
  CAST(row_id // 32 AS BIGINT) AS batch_id, CAST(row_id AS BIGINT) AS row_id, doc_id
FROM placed JOIN named USING (shard)""",
)
def shards_in_order(spark, sf_dir):
    """Batches of shards in shuffled order; the partition that delivers a shard is its position."""
    shards = shard_source.read_in_order(spark, _several_shards(spark, sf_dir), shuffle=True, seed=7)
    batched = shard_source.batches_in_order(shards, seed=7)
    return batched.withColumn("delivered", F.spark_partition_id().cast("long"))


@query(
    "shards_read_once",
    f"""{_NUMBERED}, sized AS (
  SELECT CAST(row_id // 150 AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS documents FROM numbered GROUP BY 1
)
SELECT printf('shard_%04d.parquet', n) AS shard, n AS position,
  CASE WHEN n = 1 THEN 0 ELSE documents END AS documents, n = 1 AS damaged FROM sized""",
)
def shards_read_once(spark, sf_dir):
    """One pass gives the rows of sound shards and tells which one is damaged."""
    path = _several_shards(spark, sf_dir)
    _damage(spark, f"{path}/shard_0001.parquet")
    shards = shard_source.read_in_order(spark, path)
    return shards.groupBy("shard", "position").agg(
        F.count_if(F.col("damage").isNull()).alias("documents"),
        (F.count("damage") > 0).alias("damaged"),
    )


# ---- checks and reports ---------------------------------------------------------------


@query(
    "source_checks",
    f"""WITH {SQL_SPEECHES}
SELECT 'documents' AS "check", CAST(count(*) AS VARCHAR) AS outcome FROM speeches
UNION ALL SELECT 'unknown format', 'refused' UNION ALL SELECT 'no rows left', 'refused'
UNION ALL SELECT 'no shards', 'refused' UNION ALL SELECT 'missing column', 'refused'""",
)
def source_checks(spark, sf_dir):
    corpus = Corpus(speeches(spark, sf_dir, ["doc_id", "congno"]), "speeches", "train")
    empty = scratch_path(spark, "none")
    make_folder(spark, empty)

    def outcome(check) -> str:
        try:
            check()
        except ValueError:
            return "refused"
        return "passed"

    checks = {
        "unknown format": lambda: readers.read_corpus(spark, f"{sf_dir}/documents.xml"),
        "no rows left": lambda: corpus.where({"congno": lambda c: c > 10_000}).require_non_empty(),
        "no shards": lambda: readers.list_shards(spark, empty),
        "missing column": lambda: readers.require_columns(corpus.df, "text"),
    }
    rows = [("documents", str(corpus.require_non_empty().count()))]
    rows += [(name, outcome(check)) for name, check in checks.items()]
    return spark.createDataFrame(rows, "check string, outcome string")


@query(
    "size_comparison",
    """SELECT 'parquet' AS format, 'snappy' AS compression, true AS compared
UNION ALL SELECT 'compressed_csv', 'gzip', false UNION ALL SELECT 'jsonlines', 'gzip', true""",
)
def size_comparison(spark, sf_dir):
    view = speeches(spark, sf_dir, ["doc_id", "text", "congno"])
    results = writers.write_all_formats(view, scratch_path(spark, "sizes"), create_shards=False)
    base = results["compressed_csv"]["size_bytes"]
    for entry in results["summary"]:
        saved = entry["savings_vs_csv_percent"]
        if saved is not None:
            assert saved == round((1 - results[entry["format"]]["size_bytes"] / base) * 100, 1)
    rows = [
        (e["format"], e["compression"], e["savings_vs_csv_percent"] is not None)
        for e in results["summary"]
    ]
    return spark.createDataFrame(rows, "format string, compression string, compared boolean")


@query(
    "processing_summary",
    f"""WITH {SQL_CLEANED} SELECT 'load_dataset,clean_data,refresh_features' AS operations,
  CAST(count(*) AS BIGINT) AS documents, false AS statistics,
  CAST({len(TOPIC_COLUMNS)} AS BIGINT) AS topics FROM cleaned""",
)
def processing_summary(spark, sf_dir):
    corpus = Corpus.of(speeches(spark, sf_dir), "speeches", "train").clean().refresh_features()
    summary = corpus.processing_summary()
    row = (
        ",".join(summary["operations_performed"]),
        summary["final_dataset_size"],
        summary["statistics_available"],
        summary["topic_columns_found"],
    )
    return spark.createDataFrame([row], "operations string, documents long, statistics boolean, topics long")


@query(
    "report_history",
    f"""WITH {SQL_CLEANED}, sizes AS (SELECT count(*) AS n FROM cleaned), given AS (
  SELECT count(*) AS n FROM documents
)
SELECT CAST(0 AS BIGINT) AS step, 'load_dataset' AS operation, CAST(NULL AS DOUBLE) AS before, CAST(NULL AS DOUBLE) AS after
UNION ALL SELECT 1, 'clean_data', CAST(given.n AS DOUBLE), CAST(sizes.n AS DOUBLE) FROM given, sizes
UNION ALL SELECT 2, 'info: documents', NULL, CAST(n AS DOUBLE) FROM sizes""",
)
def report_history(spark, sf_dir):
    """What the report has stored: the history step by step, and the table information."""
    path = scratch_path(spark, "report")
    corpus = Corpus.of(speeches(spark, sf_dir), "speeches", "train").clean(counted=True)
    corpus.write_report(path)
    steps = spark.read.schema("step long, entry string").json(f"{path}/history")
    field = lambda name: F.get_json_object("entry", f"$.{name}")
    history = steps.select(
        "step",
        field("operation").alias("operation"),
        field("original_size").cast("double").alias("before"),
        field("final_size").cast("double").alias("after"),
    )
    info = spark.read.schema("documents long").json(f"{path}/info").select(
        F.lit(2).cast("long").alias("step"),
        F.lit("info: documents").alias("operation"),
        F.lit(None).cast("double").alias("before"),
        F.col("documents").cast("double").alias("after"),
    )
    return history.unionByName(info)


@query("processing_report", _tall(SQL_SPEECHES, "speeches", _BASIC))
def processing_report(spark, sf_dir):
    path = scratch_path(spark, "report")
    corpus = Corpus(speeches(spark, sf_dir), "speeches", "train")
    families = corpus.statistics(topic_analysis=False, text_analysis=False)
    corpus.write_report(path, {"basic_counts": families["basic_counts"]})
    stored = spark.read.schema("metric string, value double").json(f"{path}/statistics/basic_counts")
    return rounded(stored, "value")


_CLEAN_COLUMNS = ["doc_id", "text", "date", "congno", "legis_body", "training_set"]
_CLEANED_ROWS = f"""WITH {SQL_CLEANED}
SELECT doc_id, md5(text) AS text_md5, strftime(date, '%Y-%m-%d') AS date, congno, legis_body,
  CAST(training_set AS BIGINT) AS training_set, CAST(year AS DOUBLE) AS year FROM cleaned"""


def _cleaned_rows(stored: DataFrame) -> DataFrame:
    rows = stored.select(
        "doc_id",
        F.md5("text").alias("text_md5"),
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        "congno",
        "legis_body",
        "training_set",
        "year",
    )
    return as_double(as_long(rows, "training_set"), "year")


_register_round_trips()


def _document_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as one shard and one micro-batch, be they one file or a folder of files."""
    name = "documents.parquet"
    schema = T.StructType.fromDDL(TABLE_SCHEMAS["documents"])
    if not is_folder(spark, f"{sf_dir}/{name}"):
        return streaming.stream_shards(spark, sf_dir, schema, 1, pattern=name)
    stream = streaming.stream_shards(spark, f"{sf_dir}/{name}", schema, pattern="*")
    return stream.withColumn("shard", F.lit(name))


@query("stream_features", FEATURE_SQL)
def stream_features(spark, sf_dir):
    path = scratch_path(spark, "stream")
    view = attach(_document_stream(spark, sf_dir), spark, sf_dir, ["doc_id", *TOPIC_COLUMNS])
    run = streaming.write_stream(
        streaming.feature_stream(view), f"{path}/rows", f"{path}/checkpoint"
    )
    run.awaitTermination()
    return feature_columns(spark.read.parquet(f"{path}/rows"))


@query(
    "stream_clean",
    _CLEANED_ROWS,
)
def stream_clean(spark, sf_dir):
    path = scratch_path(spark, "stream")
    batch = cleaning.drop_short_text(speeches(spark, sf_dir, ["text", "legis_body"]))
    mode = batch.select(cleaning.category_modes(batch, ["legis_body"])["legis_body"].alias("m"))
    modes = {"legis_body": mode.first()[0]}
    view = attach(_document_stream(spark, sf_dir), spark, sf_dir, _CLEAN_COLUMNS)
    run = streaming.write_stream(
        streaming.clean_stream(view, modes), f"{path}/rows", f"{path}/checkpoint"
    )
    run.awaitTermination()
    return _cleaned_rows(spark.read.parquet(f"{path}/rows"))


@query(
    "stream_batches",
    f"""{_NUMBERED}
SELECT 'documents.parquet' AS shard, CAST(row_id // 32 AS BIGINT) AS batch_id,
  CAST(row_id AS BIGINT) AS row_id, doc_id FROM shuffled""",
)
def stream_batches(spark, sf_dir):
    path = scratch_path(spark, "stream")
    stream = _document_stream(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("doc_id"), "shard"
    )
    run = streaming.stream_shard_batches(stream, f"{path}/rows", f"{path}/checkpoint")
    run.awaitTermination()
    return spark.read.parquet(f"{path}/rows").drop("epoch")


# Rows arrive in three loads, by congress; each load is one run of the streams, so the
# second and third go on from the checkpoints.
_LOADS = 3
_LOADED = f"""WITH {SQL_CLEANED}, loaded AS (
  SELECT doc_id, congno % {_LOADS} AS load, legis_body FROM kept
)"""


def _arriving(spark: SparkSession, sf_dir: str, path: str) -> Iterator[DataFrame]:
    """The shard directory as a stream, once per load."""
    columns = ["doc_id", "text", "congno", "legis_body"]
    view = speeches(spark, sf_dir, columns)
    for load in range(_LOADS):
        view.filter(F.col("congno") % _LOADS == load).write.mode("append").parquet(path)
        yield streaming.stream_shards(spark, path, view.schema).drop("shard")


@query(
    "stream_category_counts",
    f"""{_LOADED}
SELECT 'legis_body' AS "column", legis_body AS value, CAST(count(*) AS BIGINT) AS n
FROM loaded WHERE legis_body IS NOT NULL GROUP BY legis_body""",
)
def stream_category_counts(spark, sf_dir):
    path = scratch_path(spark, "stream")
    for stream in _arriving(spark, sf_dir, f"{path}/in"):
        categories.count_categories(stream, f"{path}/counts").awaitTermination()
    return categories.category_counts(spark, f"{path}/counts")


@query(
    "stream_clean_by_counts",
    f"""{_LOADED}, counted AS (
  SELECT l.load, legis_body, count(*) AS n
  FROM (SELECT unnest(range({_LOADS})) AS load) l JOIN loaded ON loaded.load <= l.load
  WHERE legis_body IS NOT NULL GROUP BY ALL
), modes AS (
  SELECT load, legis_body AS most FROM counted
  QUALIFY row_number() OVER (PARTITION BY load ORDER BY n DESC, legis_body) = 1
)
SELECT doc_id, coalesce(legis_body, most, 'unknown') AS legis_body
FROM loaded LEFT JOIN modes USING (load)""",
)
def stream_clean_by_counts(spark, sf_dir):
    path = scratch_path(spark, "stream")
    for stream in _arriving(spark, sf_dir, f"{path}/in"):
        categories.count_categories(stream, f"{path}/counts").awaitTermination()
        categories.clean_by_counts(
            stream, f"{path}/rows", f"{path}/cleaned", f"{path}/counts"
        ).awaitTermination()
    return spark.read.parquet(f"{path}/rows").select("doc_id", "legis_body")
