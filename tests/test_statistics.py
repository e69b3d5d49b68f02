"""Statistics and validation on small tables with known results."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from collected import rows
from rostrum.operators import statistics as stats, validation
from rostrum.operators.features import with_topic_features
from rostrum.operators.quantiles import approximate_quantiles, counted_quantile, exact_quantiles, with_ranks

PROBABILITIES = [0.1, 0.25, 0.5, 0.75, 0.9]


def quantile_map(df):
    return {(r[0], r.p): r.quantile for r in df.collect()}


def test_exact_quantiles_of_huge_values(spark):
    values = [1e300, -1e300, 1.7e308, 0.0, 5.0, float("inf")]
    df = spark.createDataFrame([(v, "g") for v in values], "v double, g string")
    found = {r.p: r.quantile for r in exact_quantiles(df, "v", [0.0, 0.4, 0.6, 0.8], "g").collect()}
    assert found == {0.0: -1e300, 0.4: 5.0, 0.6: 1e300, 0.8: 1.7e308}


@pytest.mark.parametrize(
    "name", ["skewed", "mostly_zero", "negative", "single", "constant", "few", "tiny_and_huge"]
)
def test_exact_quantiles_equal_pandas(spark, name):
    rng = np.random.default_rng(7)
    values = {
        "skewed": rng.exponential(size=3000) ** 3,
        "mostly_zero": np.where(rng.random(3000) < 0.6, 0.0, rng.random(3000)),
        "negative": rng.normal(size=1001) * 1e6,
        "single": np.array([3.0]),
        "constant": np.full(100, 0.25),
        "few": np.array([1.0, 2.0, 3.0, 10.0]),
        "tiny_and_huge": np.concatenate([rng.random(500) * 1e-15, rng.random(500) * 1e18]),
    }[name]
    df = spark.createDataFrame(pd.DataFrame({"g": "x", "v": values}))
    df = df.unionByName(spark.createDataFrame([("x", None), ("empty", None)], "g string, v double"))
    got = quantile_map(exact_quantiles(df, "v", PROBABILITIES, "g"))
    want = pd.Series(values)
    assert set(got) == {("x", p) for p in PROBABILITIES}
    for p in PROBABILITIES:
        assert got["x", p] == pytest.approx(want.quantile(p), rel=1e-12, abs=1e-300)


def test_quantiles_by_group_and_from_counts(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 10.0), ("b", 5.0)], "g string, v double"
    )
    want = {("a", 0.25): 1.75, ("a", 0.5): 2.5, ("b", 0.25): 5.0, ("b", 0.5): 5.0}
    assert quantile_map(exact_quantiles(df, "v", [0.25, 0.5], "g")) == want
    counts = with_ranks(df.groupBy("g", "v").agg(F.count("*").alias("n")), "g").groupBy("g")
    counted = counts.agg(counted_quantile(0.25), counted_quantile(0.5))
    assert sorted(rows(counted)) == [("a", 1.75, 2.5), ("b", 5.0, 5.0)]
    near = quantile_map(approximate_quantiles(df, "v", [0.5], "g"))
    assert near["b", 0.5] == 5.0 and near["a", 0.5] in (2.0, 3.0)


def test_topic_summary(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "tw_a double")
    row = stats.topic_summary(df).first()
    assert row["std"] == pytest.approx(4.082483, abs=1e-6)
    assert (row["mean"], row["min"], row["max"], row["median"], row["q25"]) == (4, 1, 10, 2.5, 1.75)
    assert (row["active_documents"], row["zero_weight_documents"]) == (4, 0)


def test_single_row_has_no_deviation(spark):
    df = spark.createDataFrame([(1.0,)], "tw_a double")
    assert stats.topic_summary(df, quantiles=False).first()["std"] is None


def test_all_missing_topic_is_kept(spark):
    df = spark.createDataFrame([(None, 1.0)], "tw_a double, tw_b double")
    summary = {r["topic"]: r for r in stats.topic_summary(df).collect()}
    assert summary["tw_a"]["median"] is None and summary["tw_b"]["median"] == 1.0


def test_pairwise_correlation(spark):
    df = spark.createDataFrame(
        [(1.0, 1.0, 1.0), (2.0, 2.5, 1.0), (4.0, 3.0, 1.0), (None, 9.0, 1.0), (7.0, None, 1.0)],
        "tw_a double, tw_b double, tw_c double",
    )
    found = rows(stats.topic_correlations(df))
    assert [(a, b) for a, b, _ in found] == [("tw_a", "tw_b")]
    assert found[0][2] == pytest.approx(0.891042, abs=1e-6)


def test_correlations_equal_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.random((200, 5)), columns=[f"tw_{c}" for c in "abcde"])
    pdf = pdf.mask(rng.random(pdf.shape) < 0.2)
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"{c} double" for c in pdf))
    want = pdf.corr()
    found = rows(stats.topic_correlations(df, k=None))
    assert len(found) == 10
    for a, b, value in found:
        assert value == pytest.approx(want.loc[a, b], abs=1e-12)
    assert [v for _, _, v in found] == sorted((v for _, _, v in found), reverse=True)


def test_dominant_distribution_skips_missing(spark):
    df = with_topic_features(
        spark.createDataFrame([(0.1, 0.9), (0.9, 0.1), (None, None), (0.8, 0.1)], "tw_a double, tw_b double")
    )
    assert rows(stats.dominant_distribution(df)) == [("tw_a", "A", 2), ("tw_b", "B", 1)]


def test_duplicates_count_missing_ids_as_equal(spark):
    df = spark.createDataFrame([("a",), (None,), (None,), ("a",)], "doc_id string")
    assert stats.duplicate_ids(df).first()[0] == 2
    assert stats.duplicate_ids(df.limit(0)).first()[0] == 0


def test_missing_data(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert rows(stats.missing_data(df)) == [("b", 1, 50.0)]


def test_text_statistics(spark):
    texts = ["a b", "abcd efg h", "", "x y z w v", None]
    table = {r["measure"]: r for r in stats.text_statistics(
        spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    lengths = pd.Series([3, 10, 0, 9])
    assert table["length"]["mean"] == lengths.mean()
    assert table["length"]["std"] == pytest.approx(lengths.std())
    assert table["length"]["median"] == lengths.median()
    assert table["length"]["p90"] == int(lengths.quantile(0.9))
    assert (table["words"]["min"], table["words"]["max"]) == (0, 5)


def test_date_range_without_valid_dates(spark):
    row = stats.date_range(spark.createDataFrame([("bad",)], "date string")).first()
    assert tuple(row) == (None, None, None, 0, 1)


def test_congress_years_and_coverage(spark):
    df = spark.createDataFrame(
        [(108, "2003-05-01"), (108, "2004-01-05"), (109, "bad"), (None, "2004-01-01")],
        "congno bigint, date string",
    )
    assert sorted(rows(stats.congress_years(df))) == [(108, 2003, 2004, 2), (109, None, None, 0)]
    assert stats.years_covered(df).first()[0] == 2
    assert stats.congress_span(df).first()[0] == "108-109"


def test_corpus_metrics_agree_with_single_families(spark):
    df = with_topic_features(
        spark.createDataFrame(
            [("a" * 120, "2004-01-05", 0.2, 0.8), ("b c", "bad", 0.0, 0.0), ("", None, 0.9, 0.9)],
            "text string, date string, tw_a double, tw_b double",
        )
    )
    metrics = {(f, m): v for f, m, v in rows(stats.corpus_metrics(df))}
    for family, table in {
        "active_topics": stats.active_topics(df),
        "weight_quality": None,
    }.items():
        if table is not None:
            for metric, value in rows(table):
                assert metrics[family, metric] == value
    quality = dict(rows(stats.quality_metrics(df)))
    assert metrics["text_quality", "percentage_problematic"] == quality["percentage_problematic"] == 100.0
    assert quality["percentage_problematic_distinct"] == pytest.approx(200 / 3)
    assert (metrics["weight_quality", "high_sum_documents"], quality["zero_weight_documents"]) == (1, 1)


def report(df):
    return {(r.category, r.rule, r.column): (r.violations, r.passed)
            for r in validation.validation_report(df).collect()}


def test_validation_rules(spark):
    df = spark.createDataFrame(
        [
            ("long enough text", "2004-01-05", 110, 1, 0.5, None),
            ("long enough text", "2004-01-05", 110, 1, 0.5, None),
            ("", "bad", 99, 2, 1.5, 0.0),
            ("another long text", None, None, None, 0.0, 0.0),
        ],
        "text string, date string, congno bigint, training_set int, tw_a double, tw_b double",
    )
    found = report(df)
    assert found["basic", "duplicate_rows", ""] == (1, False)
    assert found["content", "empty_text", "text"] == (1, False)
    assert found["content", "very_short_text", "text"] == (1, False)
    assert found["topic", "out_of_range", "tw_a"] == (1, False)
    assert found["topic", "missing_weight", "tw_b"] == (2, False)
    assert found["topic", "all_zero_weights", ""] == (1, False)
    assert found["consistency", "congress_out_of_range", "congno"] == (1, False)
    assert found["consistency", "invalid_date", "date"] == (2, False)
    assert found["consistency", "invalid_flag", "training_set"] == (2, False)
    score = validation.validation_score(validation.validation_report(df)).first()
    assert tuple(score) == (0, 4, 0.0)


@pytest.mark.parametrize("short, passed", [(5, True), (6, False)])
def test_very_short_share(spark, short, passed):
    texts = [("tiny",)] * short + [(f"long enough text {i}",) for i in range(100 - short)]
    found = report(spark.createDataFrame(texts, "text string"))
    assert found["content", "very_short_text", "text"] == (short, passed)


def test_score_without_topics_and_of_an_empty_table(spark):
    clean = spark.createDataFrame([("long enough text",)], "text string")
    assert validation.validation_score(validation.validation_report(clean)).first().score == 100.0
    empty = validation.validation_report(clean.limit(0))
    assert report(clean.limit(0))["basic", "empty_table", ""] == (1, False)
    assert validation.validation_score(empty).first().score == 75.0
    no_text = spark.createDataFrame([(1,)], "x int")
    assert report(no_text)["basic", "missing_column", "text"] == (1, False)


def test_duplicate_rows_tell_null_positions_apart(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("a", ""), ("", "a")], "x string, y string")
    assert validation.duplicate_rows(df).first().duplicate_rows == 0
    zeros = spark.createDataFrame([(0.0,), (-0.0,)], "x double")
    assert validation.duplicate_rows(zeros).first().duplicate_rows == 1


def test_breakdowns_are_the_single_groupings(spark):
    data = [
        (b, c, y, f, "x" * n, w)
        for n, (b, c, y, f, w) in enumerate([
            ("H", 1, 2000, 1, 0.5), ("H", 1, 2001, 0, None), (None, 1, None, 1, 0.25),
            (None, None, 2000, None, 1.0), ("S", 2, 2000, 1, 0.0), ("S", 2, 2000, 1, 0.0),
        ])
    ]
    schema = "legis_body string, congno long, year int, training_set int, text string, tw_economy double"
    df = spark.createDataFrame(data, schema)
    found = stats.breakdowns(df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    for columns in stats.BREAKDOWNS:
        want = df.groupBy(*columns).agg(
            F.count("*"), F.avg(F.length("text")), F.avg("tw_economy")
        )
        part = found.filter(F.col("breakdown") == "+".join(columns))
        got = part.select(*columns, "documents", "mean_length", "tw_economy")
        assert sorted(map(str, rows(got))) == sorted(map(str, rows(want)))
    assert found.filter("breakdown IS NULL").count() == 0


def test_breakdowns_of_few_columns_and_of_no_rows(spark):
    df = spark.createDataFrame([("H", "2001-02-03"), ("H", "n/a")], "legis_body string, date string")
    got = {(r.breakdown, r.legis_body, r.year): r.documents for r in stats.breakdowns(df).collect()}
    assert got == {("legis_body", "H", None): 2, ("year", None, 2001): 1, ("year", None, None): 1}
    assert rows(stats.breakdowns(df.limit(0))) == []
    with pytest.raises(ValueError, match="no column"):
        stats.breakdowns(spark.createDataFrame([(1,)], "x int"))
