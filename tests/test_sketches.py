"""Sketches per shard and what they are merged to."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from collected import rows
from rostrum.operators import sketches

SCHEMA = "shard string, doc_id string, bonica_rid string, text string, tw_economy double"


@pytest.fixture(scope="module")
def frame():
    draw = np.random.default_rng(5)
    n = 60_000
    # Two thirds of the rows are in one shard; weights lie far from zero and close together.
    return pd.DataFrame({
        "shard": draw.choice(["a", "b", "c"], n, p=[0.66, 0.33, 0.01]),
        "doc_id": [f"d{i}" for i in range(n)],
        "bonica_rid": [str(i % 700) if i % 11 else None for i in range(n)],
        "text": ["x " * (i % 40) if i % 13 else None for i in range(n)],
        "tw_economy": 1e6 + draw.normal(size=n),
    })


@pytest.fixture(scope="module")
def made(spark, frame):
    return sketches.shard_sketches(spark.createDataFrame(frame, SCHEMA)).cache()


def _by_measure(df):
    return {r.measure: r for r in df.collect()}


@pytest.mark.parametrize("shards", [["a"], ["b", "c"], ["a", "b", "c"]])
def test_merged_statistics(made, frame, shards):
    part = frame[frame.shard.isin(shards)]
    kept = made.filter(made["shard"].isin(shards))
    got = _by_measure(sketches.summary(kept, {0.01: "low", 0.5: "median", 0.99: "high"}))
    assert set(got) == {"tw_economy", "text_length", "text_words"}
    weight = got["tw_economy"]
    assert weight.n == len(part)
    assert weight.mean == pytest.approx(part.tw_economy.mean(), rel=1e-12)
    assert weight.std == pytest.approx(part.tw_economy.std(), rel=1e-6)
    assert (weight.min, weight.max) == (part.tw_economy.min(), part.tw_economy.max())
    for p, found in ((0.01, weight.low), (0.5, weight.median), (0.99, weight.high)):
        assert (part.tw_economy <= found).mean() == pytest.approx(p, abs=0.015)
    assert got["text_length"].n == part.text.notna().sum()
    assert got["text_length"].mean == pytest.approx(part.text.dropna().str.len().mean())
    counts = _by_measure(sketches.distinct_counts(kept))
    for name in ("doc_id", "bonica_rid"):
        assert counts[name].n == part[name].notna().sum()
        assert counts[name].distinct_values == pytest.approx(part[name].nunique(), rel=0.04)


def test_a_row_per_shard_and_measure(made):
    assert made.count() == 3 * 5
    assert made.groupBy("shard", "measure").count().filter("count > 1").count() == 0


def test_only_new_shards_are_added(spark, tmp_path):
    path = str(tmp_path / "sketches")
    data = [("a", "1", None, "t", 0.5), (None, "2", None, "t", 0.25), ("b", "3", None, "t", 1.0)]
    df = spark.createDataFrame(data, SCHEMA)
    sketches.add_sketches(df.filter("shard = 'a'"), path)
    for _ in range(2):
        stored = sketches.add_sketches(df, path)
        assert _by_measure(sketches.summary(stored))["tw_economy"].n == 3
        assert _by_measure(sketches.distinct_counts(stored))["doc_id"].distinct_values == 3


def test_summary_reads_no_documents(spark, frame, tmp_path):
    source, path = str(tmp_path / "documents"), str(tmp_path / "sketches")
    spark.createDataFrame(frame.head(100), SCHEMA).write.parquet(source)
    stored = sketches.add_sketches(spark.read.parquet(source), path)
    plan = sketches.summary(stored.filter("shard = 'a'"))._jdf.queryExecution().executedPlan()
    assert "tmp_path" not in plan.toString() and source not in plan.toString()
    assert "PushedFilters: [IsNotNull" in plan.toString()


def test_missing_values_and_one_value(spark):
    data = [("a", None, None, None, None), ("b", "1", None, "", 0.5), ("b", "1", None, None, None)]
    made = sketches.shard_sketches(spark.createDataFrame(data, SCHEMA))
    got = _by_measure(sketches.summary(made))
    weight = got["tw_economy"]
    assert (weight.n, weight.mean, weight.std, weight.median) == (1, 0.5, None, 0.5)
    assert (got["text_length"].n, got["text_length"].max) == (1, 0.0)
    nothing = _by_measure(sketches.summary(made.filter("shard = 'a'")))["tw_economy"]
    assert (nothing.n, nothing.mean, nothing.std, nothing.median) == (0, None, None, None)
    counts = _by_measure(sketches.distinct_counts(made))
    assert (counts["doc_id"].n, counts["doc_id"].distinct_values) == (2, 1)
    assert (counts["bonica_rid"].n, counts["bonica_rid"].distinct_values) == (0, 0)


def test_empty_table(spark):
    made = sketches.shard_sketches(spark.createDataFrame([], SCHEMA))
    assert rows(made) == rows(sketches.summary(made)) == rows(sketches.distinct_counts(made)) == []
    with pytest.raises(ValueError, match="no column"):
        sketches.shard_sketches(spark.createDataFrame([("a",)], "shard string"))
