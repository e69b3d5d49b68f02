"""Row positions, samples, batches and splits, also with very frequent keys."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from collected import rows
from rostrum.operators import batches, numbering, sampling, splits


def md5_key(doc_id, seed=42):
    return hashlib.md5(f"{seed}:{doc_id}".encode()).hexdigest()


@pytest.fixture(scope="module")
def plain(spark):
    return spark.range(0, 1000, 1, 7).select(
        F.col("id").cast("string").alias("doc_id"), (F.col("id") * 2).alias("v")
    )


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows shares one id, and most of those are equal rows."""
    return spark.range(0, 900, 1, 5).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.col("id") % 2).otherwise(F.col("id")).alias("v"),
    )


def positions(df):
    return sorted(r.row_id for r in df.select("row_id").collect())


def test_key_order(plain):
    numbered = numbering.number_by_key(plain, ["doc_id"])
    found = dict(rows(numbered.select("row_id", "doc_id")))
    assert [found[i] for i in range(1000)] == sorted(str(i) for i in range(1000))


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_key_order_does_not_depend_on_partitions(plain, partitions):
    expected = rows(numbering.number_by_key(plain, ["doc_id"]).orderBy("row_id"))
    again = numbering.number_by_key(plain.repartition(partitions), ["doc_id"], partitions)
    assert rows(again.orderBy("row_id")) == expected


def test_shuffled_order(plain):
    numbered = numbering.number_shuffled(plain)
    found = [r.doc_id for r in numbered.orderBy("row_id").collect()]
    assert found == sorted((str(i) for i in range(1000)), key=md5_key)
    assert positions(numbered) == list(range(1000))


def test_frequent_key_keeps_every_row_once(skewed):
    for numbered in (
        numbering.number_by_key(skewed, ["doc_id"]),
        numbering.number_shuffled(skewed),
    ):
        assert positions(numbered) == list(range(900))
        assert sorted(rows(numbered.drop("row_id"))) == sorted(rows(skewed))


def test_frequent_key_is_spread_over_partitions(skewed):
    placed = numbering._place(skewed, ["doc_id"], partitions=9)
    per_part = placed.filter("doc_id = 'hot'").groupBy("__part").count().collect()
    assert sum(r["count"] for r in per_part) == 300
    assert max(r["count"] for r in per_part) < 200


def test_empty_table(plain):
    empty = plain.limit(0)
    assert positions(numbering.number_by_key(empty, ["doc_id"])) == []
    assert positions(numbering.number_shuffled(empty)) == []
    assert sampling.sample_rows(empty, 5).count() == 0
    assert batches.with_batches(empty).count() == 0


def test_lookup(spark, plain):
    numbered = numbering.number_by_key(plain, ["doc_id"])

    def at(p):
        return sorted(r.row_id for r in numbering.rows_at(numbered, p).collect())

    everything = list(range(1000))
    assert at(5) == [5] and at(-1) == [999]
    assert at([0, 3, -2]) == [0, 3, 998]
    for s in (slice(10, 20), slice(0, 50, 7), slice(-5, None), slice(None, None, -100), slice(20, 10)):
        assert at(s) == sorted(everything[s])
    wanted = spark.createDataFrame([(7,), (8,)], "row_id bigint")
    assert at(wanted) == [7, 8]
    with pytest.raises(TypeError):
        numbering.rows_at(numbered, "5")
    listed = [r.row_id for r in numbering.rows_at(numbered, [9, 3, 9, -1]).collect()]
    assert listed == [9, 3, 9, 999]
    for outside in (1000, -1001, [0, 1000]):
        with pytest.raises(IndexError):
            numbering.rows_at(numbered, outside)
    assert numbering.rows_at(numbered, []).count() == 0


def test_look_up_stores_keys_alone(spark, plain, skewed, monkeypatch):
    stored = []
    materialize = numbering.materialize
    monkeypatch.setattr(
        numbering, "materialize", lambda df, name: stored.append(df.columns) or materialize(df, name)
    )
    expected = sorted(str(i) for i in range(1000))
    found = numbering.look_up(plain, [5, 2, 5, -1]).collect()
    assert [(r.row_id, r.doc_id) for r in found] == [(i, expected[i]) for i in (5, 2, 5, 999)]
    assert all("v" not in columns for columns in stored)
    # Equal rows take each other's places.
    spread = numbering.look_up(skewed, slice(0, 900, 1)).collect()
    assert sorted((r.doc_id, r.v) for r in spread) == sorted(rows(skewed))
    assert [r.row_id for r in spread] == list(range(900))


@pytest.mark.parametrize("n", [0, 1, 5, 100, 999, 1000, 2000])
def test_sample_has_exact_size_and_hash_order(plain, n):
    found = sorted(r.doc_id for r in sampling.sample_rows(plain, n).collect())
    assert found == sorted(sorted((str(i) for i in range(1000)), key=md5_key)[:n])


def test_samples_depend_on_the_seed_only(plain):
    first = sorted(rows(sampling.sample_rows(plain, 50, seed=1)))
    assert first == sorted(rows(sampling.sample_rows(plain.repartition(3), 50, seed=1)))
    assert first != sorted(rows(sampling.sample_rows(plain, 50, seed=2)))


@pytest.mark.parametrize("n", [1, 150, 301, 600])
def test_border_is_exact_with_a_frequent_key(skewed, n):
    border = numbering.first_shuffled(skewed, n)
    inside = skewed.filter(border.inside).count()
    outside = skewed.filter(border.outside).count()
    edge = {}
    if border.edge is not None:
        edge = dict(rows(border.edge.groupBy("__first").count()))
    assert inside + edge.get(True, 0) == n
    assert outside + edge.get(False, 0) == 900 - n
    assert sampling.sample_rows(skewed, n).count() == n


def test_border_of_unique_keys_is_a_plain_filter(plain):
    assert numbering.first_shuffled(plain, 123).edge is None


def test_quick_sample_filters_first(spark):
    df = spark.range(100).select(
        F.col("id").cast("string").alias("doc_id"), (F.col("id") % 4 + 108).alias("congno")
    )
    sample = sampling.quick_sample(df, 10, congress=110)
    assert sample.count() == 10 and sample.filter("congno <> 110").count() == 0


@pytest.mark.parametrize("shuffle", [True, False])
def test_batches_are_full_but_the_last(plain, shuffle):
    batched = batches.with_batches(plain, 32, shuffle)
    sizes = dict(rows(batched.groupBy("batch_id").count()))
    assert sizes == {**{i: 32 for i in range(31)}, 31: 8}


def test_columnar_batches_keep_row_order_and_missing_values(spark):
    df = spark.createDataFrame(
        [(str(i), None if i % 2 else i, 0.5) for i in range(10)],
        "doc_id string, congno int, tw_a double",
    )
    columnar = batches.columnar_batches(batches.with_batches(df, 4, shuffle=False), tensors=True)
    found = list(batches.iterate_batches(columnar))
    assert [b["doc_id"] for b in found] == [list("0123"), list("4567"), list("89")]
    assert found[0]["congno"] == [0.0, None, 2.0, None]
    assert dict(columnar.dtypes)["tw_a"] == "array<float>"


def test_batches_never_cross_shards(plain):
    df = plain.withColumn("shard", F.when(F.col("v") < 300, "a").otherwise("b"))
    batched = batches.with_shard_batches(df, batch_size=64)
    sizes = {(r.shard, r.batch_id): r["count"] for r in batched.groupBy("shard", "batch_id").count().collect()}
    assert sizes == {("a", 0): 64, ("a", 1): 64, ("a", 2): 22,
                     **{("b", i): 64 for i in range(13)}, ("b", 13): 18}
    first = [r.doc_id for r in batched.filter("shard = 'a'").orderBy("row_id").collect()]
    assert first == sorted((str(i) for i in range(150)), key=md5_key)


def test_feature_vectors(spark):
    df = spark.createDataFrame([(0.5, 110, 1)], "tw_a double, congno bigint, training_set int")
    assert list(batches.with_feature_vector(df).first().features) == [0.5, 110.0, 1.0]
    assert list(batches.with_feature_vector(df, ml=True).first().features) == [0.5, 110.0, 1.0]


@pytest.fixture(scope="module")
def flagged(spark):
    return spark.range(0, 3000, 1, 4).select(
        F.col("id").cast("string").alias("doc_id"),
        F.when(F.col("id") % 10 == 9, None).when(F.col("id") % 10 < 6, 1).otherwise(0).alias("training_set"),
    )


def test_flag_split_covers_each_flagged_row_once(flagged):
    parted = splits.split_by_flag(flagged)
    sizes = dict(rows(parted.groupBy("split").count()))
    assert sizes == {"train": 1620, "validation": 180, "test": 900}
    assert parted.select("doc_id").distinct().count() == 2700
    assert parted.filter("split = 'test' AND training_set = 1").count() == 0
    train = [r.doc_id for r in flagged.filter("training_set = 1").collect()]
    chosen = {r.doc_id for r in parted.filter("split = 'validation'").collect()}
    assert chosen == set(sorted(train, key=md5_key)[:180])


def test_validation_has_a_least_size_but_not_more_than_train(flagged):
    some = flagged.filter("CAST(doc_id AS INT) < 500")
    assert dict(rows(splits.split_by_flag(some).groupBy("split").count())) == {
        "train": 200, "validation": 100, "test": 150}
    few = flagged.filter("CAST(doc_id AS INT) < 20")
    assert dict(rows(splits.split_by_flag(few).groupBy("split").count())) == {
        "validation": 12, "test": 6}
    none = flagged.filter("training_set = 0")
    assert dict(rows(splits.split_by_flag(none).groupBy("split").count())) == {"test": 900}


def test_flag_split_with_a_frequent_id(skewed):
    df = skewed.withColumn("training_set", F.lit(1))
    sizes = dict(rows(splits.split_by_flag(df).groupBy("split").count()))
    assert sizes == {"train": 800, "validation": 100}


def test_positional_split(plain, skewed):
    parted = splits.split_by_position(plain)
    first = sorted(str(i) for i in range(1000))[:800]
    assert {r.doc_id for r in parted.filter("split = 'train'").collect()} == set(first)
    assert parted.count() == 1000
    # The border falls among the rows of one id.
    sizes = dict(rows(splits.split_by_position(skewed).groupBy("split").count()))
    assert sizes == {"train": 720, "test": 180}
    assert splits.split_by_position(plain.limit(0)).count() == 0


def test_release_split(flagged, plain):
    whole = splits.split_for_release(flagged, whole=True)
    assert dict(rows(whole.groupBy("split").count())) == {"train": 3000}
    parted = splits.split_for_release(flagged)
    assert dict(rows(parted.groupBy("split").count()))["validation"] == 180
    by_place = splits.split_for_release(plain)
    assert dict(rows(by_place.groupBy("split").count())) == {"train": 800, "test": 200}
    assert splits.prepare_splits(plain).filter("split = 'test'").count() == 200
