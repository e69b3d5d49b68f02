"""Readers, writers, streams and the corpus API."""

from __future__ import annotations

import datetime as dt
import gzip
import json
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet
import pytest
from pyspark.sql import functions as F, types as T

from collected import rows
from rostrum import Corpus, SPEECH_SCHEMA, session
from rostrum.operators.batches import with_shard_batches
from rostrum.operators.cleaning import clean
from rostrum.operators.features import with_topic_features
from rostrum.operators.numbering import place_by_key
from rostrum.plans import speech_view, storage
from rostrum.plans.speech_view import TABLE_SCHEMAS
from rostrum.plans.topics import feature_columns
from rostrum.session import shared_dir
from rostrum.sources import readers, writers
from rostrum.streaming import shards as streaming

SCHEMA = (
    "doc_id string, text string, date string, congno bigint, legis_body string, "
    "training_set int, tw_economy double, tw_healthcare double"
)


@pytest.fixture(scope="module")
def speeches(spark):
    data = [
        (
            f"d{i:03d}",
            f'line one\nline "two", {i}' if i % 5 else "",
            "2004-01-05" if i % 7 else "n/a",
            100 + i % 25,
            ("US House", "US Senate", None)[i % 3],
            (1, 0, None)[i % 3],
            i / 100 if i % 4 else None,
            0.5,
        )
        for i in range(100)
    ]
    return spark.createDataFrame(data, SCHEMA)


def same(a, b):
    columns = sorted(a.columns)
    assert sorted(b.columns) == columns
    key = lambda r: str(r)
    assert sorted(rows(a.select(columns)), key=key) == sorted(rows(b.select(columns)), key=key)


def test_parquet(spark, speeches, tmp_path):
    path = str(tmp_path / "s.parquet")
    result = writers.write_parquet(speeches, path)
    assert result["compression"] == "snappy" and result["size_bytes"] > 0
    stored = readers.read_corpus(spark, path)
    types = {f.name: f.dataType for f in stored.schema.fields}
    assert types["congno"] == T.ByteType() and types["tw_economy"] == T.FloatType()
    assert stored.count() == 100


@pytest.mark.parametrize("published", [False, True])
def test_csv(spark, speeches, tmp_path, published):
    path = str(tmp_path / "s.csv.gz")
    writers.write_csv(speeches, path, published_names=published)
    same(readers.read_corpus(spark, path), speeches)


@pytest.mark.parametrize("published", [False, True])
def test_json_lines(spark, speeches, tmp_path, published):
    path = str(tmp_path / "s.jsonl.gz")
    writers.write_json_lines(speeches, path, published_names=published)
    part = next(Path(path).glob("part-*.json.gz"))
    with gzip.open(part, "rt") as lines:
        assert set(json.loads(next(lines))) == set(speeches.columns)
    same(readers.read_corpus(spark, path).select(speeches.columns), speeches)


def test_csv_is_matched_by_name_and_cast_leniently(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text('tw.economy,congno,doc.id,extra\n0.5,110,a,x\nbad,1d,b,y\n,,"c ""q""",z\n')
    df = readers.read_corpus(spark, str(path))
    assert rows(df.select("doc_id", "congno", "tw_economy", "extra").orderBy("extra")) == [
        ("a", 110, 0.5, "x"), ("b", None, None, "y"), ('c "q"', None, None, "z"),
    ]


def test_json_nan_is_null(spark, tmp_path):
    path = tmp_path / "s.jsonl"
    path.write_text('{"doc.id": "a", "tw.economy": NaN}\n{"doc_id": "b", "tw_economy": 0.5}\n')
    df = readers.read_corpus(spark, str(path))
    assert sorted(rows(df.select("doc_id", "tw_economy"))) == [("a", None), ("b", 0.5)]


def test_unknown_format(spark):
    with pytest.raises(ValueError, match="unsupported"):
        readers.read_corpus(spark, "/nowhere/x.xml")
    with pytest.raises(ValueError, match="unsupported"):
        readers.read_corpus(spark, "/nowhere/x", format="xml")


def test_dotted_parquet(spark, tmp_path):
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame([("a", float("nan"))], "`doc.id` string, `tw.economy` double").write.parquet(path)
    assert rows(readers.read_corpus(spark, path)) == [("a", None)]


def test_filters_reach_the_scan(spark, speeches, tmp_path, capsys):
    path = str(tmp_path / "p.parquet")
    speeches.write.parquet(path)
    Corpus.of(readers.read_corpus(spark, path)).where({"congno": lambda c: c >= 110}).df.select(
        "doc_id"
    ).explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(congno,110)" in plan
    assert "ReadSchema: struct<doc_id:string,congno:bigint>" in plan


def test_split_layout(spark, speeches, tmp_path):
    root = str(tmp_path)
    for name, folder in (("train", ""), ("validation", "/validation"), ("test", "/test")):
        speeches.limit(10).withColumn("part", F.lit(name)).write.mode("append").parquet(root + folder)
    train, validation, test = readers.load_splits(spark, root)
    assert [d.first().part for d in (train, validation, test)] == ["train", "validation", "test"]
    whole = readers.read_splits(spark, root)
    assert whole.filter("split <> part").count() == 0 and whole.count() == 30
    with pytest.raises(ValueError, match="unknown split"):
        readers.read_split(spark, root, "dev")


def test_shards_skip_unreadable_files(spark, speeches, tmp_path):
    directory = tmp_path / "shards"
    for i in range(3):
        part = speeches.filter(f"substr(doc_id, 4) % 3 = {i}")
        pa.parquet.write_table(part.toArrow(), _made(directory) / f"shard_{i:04d}.parquet")
    (directory / "shard_0009.parquet").write_bytes(b"not parquet at all")
    df = readers.read_shards(spark, str(directory), speeches.schema)
    assert df.count() == 100 and df.select("shard").distinct().count() == 3
    skipped = readers.damaged_shards(spark, str(directory), speeches.schema)
    assert [(r.shard, r.rows, r.readable) for r in skipped.collect()] == [("shard_0009.parquet", None, 0)]


def damage(path: Path) -> None:
    """Break a page of a Parquet file's third row group; the footer stays whole."""
    at = pa.parquet.ParquetFile(path).metadata.row_group(2).column(0).data_page_offset
    data = bytearray(path.read_bytes())
    data[at : at + 40] = b"\xff" * 40
    path.write_bytes(bytes(data))


def test_a_damaged_shard_is_left_out_whole(spark, tmp_path):
    directory = _made(tmp_path / "shards")
    for i in range(3):
        table = pa.table({"doc_id": [f"{i}-{j}" for j in range(3000)], "x": np.random.default_rng(i).random(3000)})
        pa.parquet.write_table(table, directory / f"shard_{i:04d}.parquet", row_group_size=1000)
    damage(directory / "shard_0001.parquet")
    schema = T.StructType.fromDDL("doc_id string, x double")
    listed = readers.damaged_shards(spark, str(directory), schema).collect()
    assert [r.shard for r in listed] == ["shard_0001.parquet"]
    assert listed[0].readable < listed[0].rows == 3000
    whole = readers.read_shards(spark, str(directory), schema)
    assert sorted(rows(whole.groupBy("shard").count())) == [
        ("shard_0000.parquet", 3000), ("shard_0002.parquet", 3000)]
    with pytest.raises(Exception):  # noqa: B017, PT011
        readers.read_shards(spark, str(directory), schema, skip_corrupt=False).agg(F.max("doc_id")).collect()
    stream = streaming.stream_shards(spark, str(directory), schema, skip=["shard_0001.parquet"])
    streaming.write_stream(stream, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    same(spark.read.parquet(str(tmp_path / "o")), whole)
    strict = streaming.stream_shards(spark, str(directory), schema)
    with pytest.raises(Exception):  # noqa: B017, PT011
        streaming.write_stream(strict, str(tmp_path / "p"), str(tmp_path / "d")).awaitTermination()


def _made(directory: Path) -> Path:
    directory.mkdir(exist_ok=True)
    return directory


def test_no_shards(spark, tmp_path):
    with pytest.raises(ValueError, match="no parquet files"):
        readers.list_shards(spark, str(_made(tmp_path / "none")))


def test_require(spark, speeches):
    assert readers.require_non_empty(speeches) is speeches
    with pytest.raises(ValueError, match="empty"):
        readers.require_non_empty(speeches.limit(0))
    with pytest.raises(ValueError, match="missing required"):
        readers.require_columns(speeches, "text", "page.id")


@pytest.mark.parametrize(
    "value, narrowed", [(16384.0004, True), (16384.0006, False), (1e9 + 0.123, False), (1e300, False), (None, False)]
)
def test_float_narrowing(spark, value, narrowed):
    types = writers.narrowed_types(spark.createDataFrame([(value,)], "x double"))
    assert types["x"] == (T.FloatType() if narrowed else T.DoubleType())


@pytest.mark.parametrize(
    "low, high, wanted",
    [(0, 127, T.ByteType()), (-128, 127, T.ByteType()), (0, 128, T.ShortType()),
     (0, 40000, T.IntegerType()), (0, 2**31, T.LongType()), (None, None, T.LongType())],
)
def test_integer_narrowing(spark, low, high, wanted):
    df = spark.createDataFrame([(low,), (high,)], "x bigint")
    assert writers.narrowed_types(df)["x"] == wanted
    assert rows(writers.narrow_types(df)) == [(low,), (high,)]


def test_shard_files_are_full_but_the_last(spark, speeches, tmp_path):
    result = writers.write_shards(speeches, str(tmp_path / "sh"), 32)
    assert result["num_shards"] == 4 and result["avg_shard_size_mb"] > 0
    names = [f"shard_{i:04d}.parquet" for i in range(4)]
    assert result["shard_files"] == names
    stored = readers.read_shards(spark, str(tmp_path / "sh"))
    assert sorted(rows(stored.groupBy("shard").count())) == list(zip(names, (32, 32, 32, 4)))
    ordered = [r.doc_id for r in stored.orderBy("shard", "doc_id").collect()]
    assert ordered == sorted(ordered)
    order = rows(readers.shard_order(spark, str(tmp_path / "sh")).orderBy("position"))
    assert order == [(name, i) for i, name in enumerate(names)]
    shuffled = rows(readers.shard_order(spark, str(tmp_path / "sh"), shuffle=True, seed=3))
    assert sorted(n for n, _ in shuffled) == names and sorted(p for _, p in shuffled) == [0, 1, 2, 3]
    again = writers.write_shards(speeches.limit(40), str(tmp_path / "sh"), 32)
    assert again["num_shards"] == 2 and readers.read_shards(spark, str(tmp_path / "sh")).count() == 40
    empty = writers.write_shards(speeches.limit(0), str(tmp_path / "empty"), 32)
    assert empty["num_shards"] == 0 and empty["avg_shard_size_mb"] is None


def test_arrow_files(speeches, tmp_path):
    target = tmp_path / "arrow"
    listed = writers.write_arrow(speeches.repartition(3, "doc_id"), str(target)).collect()
    assert sum(r["rows"] for r in listed) == 100
    tables = [pa.ipc.open_file(r["path"]).read_all() for r in listed]
    assert sorted(pa.concat_tables(tables)["doc_id"].to_pylist()) == [f"d{i:03d}" for i in range(100)]
    assert not list(target.glob("*.tmp"))
    again = writers.write_arrow(speeches.limit(5).coalesce(1), str(target)).collect()
    assert [r["rows"] for r in again] == [5] and len(list(target.glob("*"))) <= 2
    assert not list(target.parent.glob("arrow-*"))


def test_all_formats(speeches, tmp_path):
    results = writers.write_all_formats(speeches, str(tmp_path / "all"), shard_rows=50)
    summary = {r["format"]: r for r in results["summary"]}
    assert set(summary) == {"parquet", "compressed_csv", "jsonlines"}
    assert summary["compressed_csv"]["savings_vs_csv_percent"] is None
    saved = (1 - results["parquet"]["size_bytes"] / results["compressed_csv"]["size_bytes"]) * 100
    assert summary["parquet"]["savings_vs_csv_percent"] == round(saved, 1)
    assert results["shards"]["num_shards"] == 2


def test_filtered_versions(spark, speeches, tmp_path):
    custom = {"none": {"column": "congno", "value": 7}, "bad": {"column": "zzz", "value": 1}}
    written, failed = writers.write_filtered(speeches, str(tmp_path / "f"), custom)
    assert "none" not in written and list(failed) == ["bad"]
    house = spark.read.parquet(written["house_only"]["file_path"])
    assert house.count() == written["house_only"]["documents"] == 34
    assert written["house_only"]["filter"] == {"column": "legis_body", "value": "US House"}
    again, _ = writers.write_filtered(speeches.limit(0), str(tmp_path / "f2"), custom)
    assert again == {}


def test_written_splits_are_read_back(spark, speeches, tmp_path):
    parted = speeches.withColumn("split", F.expr("CASE WHEN doc_id < 'd050' THEN 'train' WHEN doc_id < 'd060' THEN 'test' END")).dropna(subset=["split"])
    root = str(tmp_path / "splits")
    for _ in range(2):
        assert writers.write_splits(parted, root) == {"train": 50, "validation": 0, "test": 10}
    train, validation, test = readers.load_splits(spark, root, lambda d: d.select("doc_id"))
    assert (train.count(), validation.count(), test.count()) == (50, 0, 10)
    assert train.columns == ["doc_id"]
    assert {r.split for r in readers.read_splits(spark, root).select("split").collect()} == {"train", "test"}


@pytest.mark.parametrize("kind", ["csv", "json", "parquet"])
def test_cleaned_tables_keep_their_columns(spark, speeches, tmp_path, kind):
    cleaned = with_topic_features(clean(speeches)).withColumns({"extra": F.lit(7), "note": F.lit("1a")})
    path = str(tmp_path / "s")
    write = {"csv": writers.write_csv, "json": writers.write_json_lines}.get(kind)
    write(cleaned, path) if write else writers.write_parquet(cleaned, path, narrow=False)
    stored = readers.read_corpus(spark, path, kind)
    assert sorted(stored.columns) == sorted(cleaned.columns)
    types = dict(stored.dtypes)
    for name, kind_ in dict(cleaned.dtypes).items():
        if name not in ("date", "extra"):
            assert types[name] == kind_, name
    assert types["extra"] in ("int", "bigint") and types["note"] == "string"
    same(stored.select("doc_id", "year", "topic_entropy", "active_topic_count", "dominant_topic"),
         cleaned.select("doc_id", "year", "topic_entropy", "active_topic_count", "dominant_topic"))


def test_corpus_takes_dotted_names_and_nan_in(spark):
    df = spark.createDataFrame(
        [("a", float("nan"), 0.9), ("b", 0.5, 0.0)], "`doc.id` string, `tw.healthcare` double, `tw.economy` double")
    corpus = Corpus.of(df)
    assert corpus.topics == ["tw_healthcare", "tw_economy"]
    assert [r.doc_id for r in corpus.where_topic("tw.healthcare").df.collect()] == ["b"]
    assert [r.active_topic_count for r in corpus.df.orderBy("doc_id").collect()] == [1, 1]
    from rostrum.operators.select import topic_memberships, where_topic
    raw = spark.createDataFrame([("a", float("nan"))], "doc_id string, tw_healthcare double")
    assert where_topic(raw, "tw_healthcare").count() == topic_memberships(raw).count() == 0


def _write_shards(df, directory: Path):
    for i, part in enumerate(df.randomSplit([1.0, 1.0, 1.0], seed=1)):
        pa.parquet.write_table(part.toArrow(), _made(directory) / f"shard_{i:04d}.parquet")
    return str(directory)


def test_stream_equals_batch(spark, speeches, tmp_path):
    directory = _write_shards(speeches, tmp_path / "in")
    modes = {"legis_body": "US House"}
    stream = streaming.stream_shards(spark, directory, speeches.schema, files_per_trigger=1)
    prepared = streaming.clean_stream(streaming.feature_stream(stream), modes)
    run = streaming.write_stream(prepared, str(tmp_path / "out"), str(tmp_path / "cp"))
    run.awaitTermination()
    assert len(list((tmp_path / "cp" / "commits").glob("[0-9]*"))) == 3
    batch = clean(with_topic_features(readers.read_shards(spark, directory, speeches.schema)), modes=modes)
    same(spark.read.parquet(str(tmp_path / "out")), batch)


def test_stream_needs_modes(spark, speeches, tmp_path):
    directory = _write_shards(speeches, tmp_path / "in")
    stream = streaming.stream_shards(spark, directory, speeches.schema)
    with pytest.raises(ValueError, match="modes"):
        clean(stream)


def test_stream_batches_equal_shard_batches(spark, speeches, tmp_path):
    directory = _write_shards(speeches, tmp_path / "in")
    stream = streaming.stream_shards(spark, directory, speeches.schema, files_per_trigger=1)
    streaming.stream_shard_batches(
        stream, str(tmp_path / "out"), str(tmp_path / "cp"), batch_size=8
    ).awaitTermination()
    want = with_shard_batches(readers.read_shards(spark, directory, speeches.schema), batch_size=8)
    same(spark.read.parquet(str(tmp_path / "out")).drop("epoch"), want)


def test_small_shards_are_numbered_in_one_job(spark, tmp_path, monkeypatch):
    """Also rows without a key, and rows that come twice."""
    data = [(f"d{i % 40}" if i % 9 else None, i % 50) for i in range(100)]
    directory = _write_shards(spark.createDataFrame(data, "doc_id string, n int"), tmp_path / "in")
    schema = T.StructType.fromDDL("doc_id string, n int")
    want = with_shard_batches(readers.read_shards(spark, directory, schema), batch_size=8)
    # Numbering over range partitions stores and counts its rows first.
    monkeypatch.setattr(streaming, "with_shard_batches", None)
    stream = streaming.stream_shards(spark, directory, schema, files_per_trigger=2)
    streaming.stream_shard_batches(
        stream, str(tmp_path / "out"), str(tmp_path / "cp"), batch_size=8
    ).awaitTermination()
    same(spark.read.parquet(str(tmp_path / "out")).drop("epoch"), want)


def test_shards_inside_a_partition_are_not_shuffled(spark, tmp_path, monkeypatch):
    """Shards at the borders of partitions, and those of which two tasks read rows, are."""
    data = [(f"d{i % 300:04d}" if i % 7 else None, i % 100) for i in range(600)]
    df = spark.createDataFrame(data, "doc_id string, n int")
    shuffled = []
    plain = type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda self, *a: shuffled.append(self.count()) or plain(self, *a))
    monkeypatch.setattr(writers, "place_by_key", lambda df, keys: place_by_key(df, keys, 4))

    def check(name, most):
        path = str(tmp_path / name)
        result = writers.write_shards(df, path, 20)
        assert result["num_shards"] == 30 and sum(shuffled) <= most
        stored = [pa.parquet.read_table(f"{path}/{n}").to_pylist() for n in result["shard_files"]]
        assert all(len(s) == 20 for s in stored)
        key = lambda r: (r["doc_id"] is not None, r["doc_id"] or "")
        given = [key(r) for s in stored for r in s]
        assert given == sorted(given)
        assert sorted((key(r), r["n"]) for s in stored for r in s) == sorted(
            ((k is not None, k or ""), n) for k, n in data
        )
        shuffled.clear()

    check("whole", 8 * 20)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    spark.conf.set("parquet.block.size", "512")
    try:
        check("read in pieces", 600)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("parquet.block.size")


@pytest.mark.parametrize("few, shuffles", [(streaming.FEW_BYTES, False), (0, True)])
def test_micro_batches_of_few_bytes_are_not_shuffled(spark, tmp_path, monkeypatch, few, shuffles):
    data = [(f"d{i % 40}" if i % 9 else None, i % 50) for i in range(100)]
    directory = _write_shards(spark.createDataFrame(data, "doc_id string, n int"), tmp_path / "in")
    schema = T.StructType.fromDDL("doc_id string, n int")
    want = with_shard_batches(readers.read_shards(spark, directory, schema), batch_size=8)
    shuffled = []
    plain = type(want).repartition
    monkeypatch.setattr(type(want), "repartition", lambda self, *a: shuffled.append(a) or plain(self, *a))
    monkeypatch.setattr(streaming, "FEW_BYTES", few)
    stream = streaming.stream_shards(spark, directory, schema, files_per_trigger=2)
    streaming.stream_shard_batches(
        stream, str(tmp_path / "out"), str(tmp_path / "cp"), batch_size=8
    ).awaitTermination()
    assert bool(shuffled) == shuffles
    same(spark.read.parquet(str(tmp_path / "out")).drop("epoch"), want)


def test_micro_batches_of_few_bytes_start_no_adaptive_plans(spark, tmp_path, monkeypatch):
    """Each would leave a thread on the driver for a minute. The caller's session stays as it is."""
    directory = _write_shards(spark.createDataFrame([(f"d{i}",) for i in range(20)], "doc_id string"), tmp_path / "in")
    seen = []
    plain = type(spark.range(1).write).parquet

    def watched(self, *a, **k):
        session = self._df.sparkSession
        seen.append((session.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.adaptive.enabled")))
        return plain(self, *a, **k)

    monkeypatch.setattr(type(spark.range(1).write), "parquet", watched)
    stream = streaming.stream_shards(spark, directory, T.StructType.fromDDL("doc_id string"), files_per_trigger=1)
    streaming.stream_shard_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert seen == [("false", "true")] * 3


def test_lanes_take_every_shard_once(spark, tmp_path):
    """Whatever its name, with the files of a trigger as given, and later ones as well."""
    schema = T.StructType.fromDDL("doc_id string")

    def add(*names):
        for name in names:
            table = pa.table({"doc_id": [f"{name} {i}" for i in range(5)] + [None]})
            pa.parquet.write_table(table, _made(tmp_path / "in") / f"{name}.parquet")

    def run():
        lanes = streaming.stream_lanes(spark, str(tmp_path / "in"), schema, files_per_trigger=2)
        runs = [
            streaming.stream_shard_batches(s, f"{tmp_path}/out/lane={k}", f"{tmp_path}/cp/{k}", batch_size=4)
            for k, s in enumerate(lanes)
        ]
        streaming.await_all(runs)
        want = with_shard_batches(readers.read_shards(spark, str(tmp_path / "in"), schema), batch_size=4)
        same(spark.read.parquet(f"{tmp_path}/out").drop("lane", "epoch"), want)
        return [len(list((tmp_path / "cp" / str(k) / "commits").glob("[0-9]*"))) for k in range(len(lanes))]

    add(*[f"shard_{i:04d}" for i in range(20)], "notes", "Z", "7 of 9", "é", "shard_-")
    assert run() == [2, 2, 2, 2, 5]
    add("shard_0020", "more")
    assert run() == [3, 2, 2, 2, 6]


def test_lanes_end_together(spark, tmp_path):
    """If one fails, the others are stopped and the failure is told."""
    (_made(tmp_path / "in") / "shard_0000.parquet").write_bytes(b"\xff" * 64)
    schema = T.StructType.fromDDL("doc_id string")
    failing = streaming.stream_shards(spark, str(tmp_path / "in"), schema)
    first = streaming.stream_shard_batches(failing, f"{tmp_path}/out", f"{tmp_path}/cp")
    endless = spark.readStream.format("rate").load().writeStream.format("noop").start()
    with pytest.raises(Exception, match="shard_0000"):
        streaming.await_all([first, endless])
    assert not endless.isActive


def test_shard_files_take_few_calls(spark, tmp_path, monkeypatch):
    """Listing and renaming asks for the file system a few times, not for each file."""
    located = []
    plain = session._located
    monkeypatch.setattr(session, "_located", lambda *a: located.append(a) or plain(*a))
    df = spark.createDataFrame([(f"d{i:04d}",) for i in range(200)], "doc_id string")
    result = writers.write_shards(df, str(tmp_path / "shards"), 4)
    assert result["num_shards"] == 50 and len(located) < 50
    stored = [pa.parquet.read_table(tmp_path / "shards" / n)["doc_id"].to_pylist() for n in result["shard_files"]]
    assert [d for s in stored for d in s] == [f"d{i:04d}" for i in range(200)]


@pytest.fixture(scope="module")
def parted(spark, tmp_path_factory):
    """Tables whose documents are a folder of three files."""
    root = tmp_path_factory.mktemp("parted")
    data = [(i, f"text  number {i}" if i % 5 else None, ("en", "fr", None)[i % 3], "web1", 9) for i in range(60)]
    documents = spark.createDataFrame(data, TABLE_SCHEMAS["documents"])
    documents.repartition(3).write.parquet(str(root / "documents.parquet"))
    assert len(list((root / "documents.parquet").glob("part-*.parquet"))) == 3
    # The other tables are one file each, as generated.
    orders = [(i, i % 7, dt.datetime(2004, 1, 5)) for i in range(50)]
    weights = [(i, [0.1 * (k % (i + 2)) for k in range(25)], 0) for i in range(55)]
    others = {"orders": orders, "labels": [(i, i % 2, 0) for i in range(40)], "embeddings": weights}
    for name, made in others.items():
        table = spark.createDataFrame(made, TABLE_SCHEMAS[name]).toArrow()
        pa.parquet.write_table(table, root / f"{name}.parquet")
    return str(root)


def test_stream_batches_of_a_folder_of_documents(spark, parted):
    """The folder is one shard: its batches go across its files."""
    documents = spark.read.parquet(f"{parted}/documents.parquet")
    shard = documents.select(F.col("doc_id").cast("string"), F.lit("documents.parquet").alias("shard"))
    same(storage.stream_batches(spark, parted), with_shard_batches(shard))


def test_stream_clean_of_a_folder_of_documents(spark, parted):
    view = speech_view.speeches(spark, parted, storage._CLEAN_COLUMNS)
    same(storage.stream_clean(spark, parted), storage._cleaned_rows(clean(view)))


def test_stream_features_of_a_folder_of_documents(spark, parted):
    same(storage.stream_features(spark, parted), feature_columns(speech_view.features(spark, parted)))


def test_checkpoint_folder_is_the_configured_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert spark.sparkContext.getCheckpointDir().startswith("file:" + shared_dir(spark))


def test_corpus_pipeline(spark, speeches, tmp_path):
    path = str(tmp_path / "s.parquet")
    speeches.write.parquet(path)
    corpus = Corpus.load(spark, path, filters={"congno": lambda c: c >= 105}, sample_size=50)
    assert corpus.count() == 50 and corpus.topics == ["tw_economy", "tw_healthcare"]
    cleaned = corpus.clean(counted=True).refresh_features()
    sizes = cleaned.history[1]
    assert sizes["original_size"] - sizes["removed"] == sizes["final_size"] == cleaned.count()
    assert set(cleaned.topic_summary()) == {
        "topic_statistics", "dominant_topic_distribution", "topic_diversity", "active_topics"}
    assert not cleaned.processing_summary()["statistics_available"]
    cleaned, families = cleaned.analyze()
    assert all(table.columns for table in families.values()) and len(families) >= 15
    assert 0 <= cleaned.validation_score().first().score <= 100
    cleaned.write_report(str(tmp_path / "report"), {"basic": families["basic_counts"]})
    history = spark.read.json(str(tmp_path / "report" / "history")).orderBy("step").collect()
    assert [json.loads(r.entry)["operation"] for r in history] == [
        "load_dataset", "clean_data", "refresh_features", "compute_statistics"]
    summary = cleaned.processing_summary()
    assert summary["final_dataset_size"] == cleaned.count()
    assert summary["topic_columns_found"] == 2 and summary["statistics_available"]


def test_corpus_projection_without_id_still_samples(spark, speeches):
    corpus = Corpus.of(speeches, columns=["text", "congno"], sample_size=10)
    assert corpus.df.columns == ["text", "congno"] and corpus.count() == 10


def test_corpus_lookup_batches_and_parts(speeches):
    corpus = Corpus.of(speeches)
    assert corpus.rows(slice(0, 3)).count() == 3
    assert corpus.sample(5).count() == 5
    assert sum(len(b["doc_id"]) for b in corpus.iterate_batches(32)) == 100
    assert set(corpus.split_by("legis_body")) == {"US House", "US Senate", None}
    assert set(corpus.topic_subsets()) == {"healthcare", "economy"}
    assert corpus.splits().filter("split = 'test'").count() == 33
    assert corpus.where_topic("tw.economy", 0.9).count() == 8
    assert corpus.where_python({"congno": lambda x: x == 110}).count() == 4
    info = corpus.info().first()
    assert (info.documents, info.start_date) == (100, dt.date(2004, 1, 5))


def test_published_schema():
    names = [f.metadata["published_name"] for f in SPEECH_SCHEMA.fields]
    assert names[:4] == ["doc.id", "bonica.rid", "bill.id", "page.id"] and len(names) == 36
