"""Category counts in the state of a stream."""

from __future__ import annotations

import pytest

from collected import rows
from rostrum.operators.cleaning import clean
from rostrum.streaming import categories, stream_shards

SCHEMA = "doc_id string, text string, legis_body string"
LONG = "long enough to be kept"


def _load(spark, folder, data):
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def _stream(spark, folder):
    schema = spark.createDataFrame([], SCHEMA).schema
    return stream_shards(spark, folder, schema, files_per_trigger=1).drop("shard")


def _counts(spark, checkpoint):
    return {(r["column"], r["value"]): r["n"] for r in categories.category_counts(spark, checkpoint).collect()}


def test_counts_go_on_after_a_restart(spark, tmp_path):
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    want = {}
    for i, values in enumerate((["a", "a", None], ["b"] * 3, ["a", "b", "c"])):
        _load(spark, folder, [(f"{i}-{j}", LONG, v) for j, v in enumerate(values)])
        categories.count_categories(_stream(spark, folder), state).awaitTermination()
        for value in filter(None, values):
            want["legis_body", value] = want.get(("legis_body", value), 0) + 1
        assert _counts(spark, state) == want
    # Nothing new: a further run changes nothing.
    categories.count_categories(_stream(spark, folder), state).awaitTermination()
    assert _counts(spark, state) == want == {
        ("legis_body", "a"): 3, ("legis_body", "b"): 4, ("legis_body", "c"): 1
    }
    assert categories.modes_so_far(spark, state) == {"legis_body": "b"}


def test_each_load_is_cleaned_with_the_mode_of_its_time(spark, tmp_path):
    paths = [str(tmp_path / name) for name in ("in", "out", "cleaned", "state")]
    folder, out, cleaned, state = paths
    for load in ([("1", LONG, "z"), ("2", LONG, None)], [("3", LONG, "y"), ("4", LONG, None)],
                 [("5", LONG, "z"), ("6", "short", "y"), ("7", LONG, None)]):
        _load(spark, folder, load)
        categories.count_categories(_stream(spark, folder), state).awaitTermination()
        categories.clean_by_counts(_stream(spark, folder), out, cleaned, state).awaitTermination()
    # After the second load both values are there once: the smaller one is the mode. The
    # third load's short text is neither counted nor kept.
    got = {r.doc_id: r.legis_body for r in spark.read.parquet(out).collect()}
    assert got == {"1": "z", "2": "z", "3": "y", "4": "y", "5": "z", "7": "z"}
    once = categories.modes_so_far(spark, state)
    batch = clean(spark.read.schema(SCHEMA).parquet(folder))
    assert once == {"legis_body": "z"}
    assert {r.doc_id for r in batch.collect()} == set(got)


def test_all_missing_and_empty(spark, tmp_path):
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    assert rows(categories.category_counts(spark, state)) == []
    _load(spark, folder, [])
    _load(spark, folder, [("1", LONG, None), ("2", None, "a")])
    categories.count_categories(_stream(spark, folder), state).awaitTermination()
    assert _counts(spark, state) == {} and categories.modes_so_far(spark, state) == {}
    categories.clean_by_counts(
        _stream(spark, folder), str(tmp_path / "out"), str(tmp_path / "cleaned"), state
    ).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.doc_id, r.legis_body) for r in got] == [("1", "unknown")]


def test_short_texts_count_if_asked(spark, tmp_path):
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    _load(spark, folder, [("1", "short", "a")])
    run = categories.count_categories(_stream(spark, folder), state, min_length=None)
    run.awaitTermination()
    assert _counts(spark, state) == {("legis_body", "a"): 1}


def test_no_category_column(spark, tmp_path):
    folder = str(tmp_path / "in")
    _load(spark, folder, [("1", LONG, "a")])
    with pytest.raises(ValueError, match="none of the columns"):
        categories.count_categories(_stream(spark, folder).drop("legis_body"), str(tmp_path / "s"))
