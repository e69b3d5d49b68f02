"""Position index over stored shards, and shards read whole in order."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F, types as T

from rostrum.operators import numbering
from rostrum.operators.positions import PositionIndex, build_index
from rostrum.sources import readers, shard_source, writers


@pytest.fixture(scope="module")
def table(spark):
    rows = [(f"d{i:04d}", f"text {i}" if i % 9 else None, float("nan") if i % 7 == 0 else i / 3) for i in range(530)]
    return spark.createDataFrame(rows, "doc_id string, text string, tw_economy double").repartition(5).cache()


@pytest.fixture(scope="module")
def shards(spark, table, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("shards") / "set")
    writers.write_shards(table, path, 100)
    return path


def test_index_finds_rows_by_position(spark, shards):
    index = build_index(spark, shards)
    assert index.count() == 530
    entries = index.entries.orderBy("first").collect()
    assert [(e["shard"], e["first"], e["rows"]) for e in entries] == [
        (f"shard_{k:04d}.parquet", 100 * k, 100 if k < 5 else 30) for k in range(6)
    ]
    assert (entries[1].first_key, entries[1].last_key) == ("d0100", "d0199")

    def at(positions):
        return [(r.row_id, r.doc_id) for r in index.rows_at(positions).collect()]

    def rows(*positions):
        return [(p, f"d{p:04d}") for p in positions]

    assert at(0) == rows(0) and at(-1) == rows(529) and at(399) == rows(399)
    assert at([529, 5, 100, 5, -530]) == rows(529, 5, 100, 5, 0)
    for part in (slice(95, 320, 9), slice(None, None, -50), slice(-40, None), slice(7, 7), slice(600, 700)):
        assert sorted(at(part)) == rows(*sorted(range(530)[part]))
    assert at([]) == []
    for outside in (530, -531, [0, 999]):
        with pytest.raises(IndexError):
            index.rows_at(outside)
    for odd in ("5", True, 1.5):
        with pytest.raises(TypeError):
            index.rows_at(odd)
    assert [r.doc_id for r in index.at_keys(["d0123", "d0400", "none"]).orderBy("doc_id").collect()] == ["d0123", "d0400"]
    found = index.rows_at(7)
    assert found.columns == ["doc_id", "text", "tw_economy", "row_id"] and found.first().tw_economy is None


def test_a_look_up_opens_the_files_it_needs(spark, shards):
    index = build_index(spark, shards)
    assert [f["shard"] for f in index.files_of([101, 140, 529])] == ["shard_0001.parquet", "shard_0005.parquet"]
    found = index.rows_at(250)
    assert [f.rsplit("/", 1)[1] for f in found.inputFiles()] == ["shard_0002.parquet"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    # The one exchange orders the rows found.
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert plan.count("rangepartitioning") == 1


def test_index_of_changed_shards(spark, table, tmp_path):
    path = str(tmp_path / "set")
    with pytest.raises(ValueError, match="no index"):
        PositionIndex(spark, path)
    writers.write_shards(table.limit(200), path, 100)
    index = build_index(spark, path)
    # The index is no shard.
    assert readers.list_shards(spark, path).count() == 2
    table.limit(70).coalesce(1).write.parquet(str(tmp_path / "other"))
    (other,) = (tmp_path / "other").glob("*.parquet")
    (tmp_path / "set" / "shard_0001.parquet").write_bytes(other.read_bytes())
    for crc in (tmp_path / "set").glob(".*.crc"):
        crc.write_bytes(b"")
    with pytest.raises(Exception, match="changed|checksum|Checksum|CRC"):
        index.rows_at(150).collect()


def test_look_up_filters_before_it_shuffles(spark, table):
    found = numbering.look_up(table, [5, 2, 5, -1])
    assert [r.row_id for r in found.collect()] == [5, 2, 5, 529]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # Wide rows go through a semi join with the few keys before they are told apart.
    assert "LeftSemi" in plan
    assert sorted(r.doc_id for r in numbering.look_up(table, slice(3, 40, 9)).collect()) == ["d0003", "d0012", "d0021", "d0030", "d0039"]


def test_shards_come_in_order(spark, shards):
    by_name = shard_source.read_in_order(spark, shards)
    assert by_name.columns == ["doc_id", "text", "tw_economy", "shard", "position", "damage"]
    assert by_name.rdd.getNumPartitions() == 6
    assert [r.doc_id for r in by_name.toLocalIterator()] == [f"d{i:04d}" for i in range(530)]
    assert by_name.filter("isnan(tw_economy)").count() == 0
    shuffled = shard_source.read_in_order(spark, shards, shuffle=True, seed=9)
    told = {(r.shard, r.position) for r in shuffled.select("shard", "position").distinct().collect()}
    assert told == {(r.shard, r.position) for r in readers.shard_order(spark, shards, True, 9).collect()}
    batches = list(shard_source.iterate_shard_batches(shard_source.batches_in_order(shuffled, 32, seed=9)))
    assert [b["position"][0] for b in batches] == sorted(b["position"][0] for b in batches)
    assert all(len(set(b["shard"])) == 1 for b in batches)
    assert [len(b["doc_id"]) for b in batches if b["shard"][0] != "shard_0005.parquet"] == [32, 32, 32, 4] * 5
    first = [d for b in batches if b["position"][0] == 0 for d in b["doc_id"]]
    assert first == sorted(first, key=lambda d: hashlib.md5(f"9:{d}".encode()).hexdigest())
    plain = shard_source.batches_in_order(by_name, 50, shuffle=False)
    assert [r.doc_id for r in plain.filter("batch_id = 1 AND position = 2").collect()] == [f"d{i:04d}" for i in range(250, 300)]


@pytest.mark.parametrize("hold", [shard_source.HOLD_BYTES, 10])
def test_a_damaged_shard_gives_none_of_its_rows(spark, table, tmp_path, hold):
    path = tmp_path / "set"
    writers.write_shards(table, str(path), 100)
    for name, cut in (("shard_0002.parquet", slice(0, 300)), ("shard_0004.parquet", slice(64, None))):
        data = (path / name).read_bytes()
        (path / name).write_bytes(data[cut] if cut.start == 0 else b"\xff" * 64 + data[cut])
    read = shard_source.read_in_order(spark, str(path), hold_bytes=hold).cache()
    damaged = shard_source.damage_of(read).collect()
    assert sorted((r.shard, r.position) for r in damaged) == [("shard_0002.parquet", 2), ("shard_0004.parquet", 4)]
    assert all(r.damage for r in damaged)
    sound = sorted(r.doc_id for r in read.filter("damage IS NULL").collect())
    assert sound == [f"d{i:04d}" for i in range(530) if i // 100 not in (2, 4)]
    assert {r.position for r in shard_source.batches_in_order(read).select("position").distinct().collect()} == {0, 1, 3, 5}


def test_columns_that_a_shard_lacks(spark, table, shards, tmp_path):
    schema = T.StructType.fromDDL("doc_id string, speaker long")
    read = shard_source.read_in_order(spark, shards, schema=schema)
    assert read.count() == 530 and read.filter(F.col("speaker").isNotNull()).count() == 0
    with pytest.raises(ValueError, match="no parquet files"):
        (tmp_path / "none").mkdir()
        shard_source.read_in_order(spark, str(tmp_path / "none"))
