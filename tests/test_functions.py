"""Edge rows of the column functions, with results worked out by hand."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from collected import rows
from rostrum.functions import parsing, predicates, text as tx, topics as tf
from rostrum.operators import cleaning, select
from rostrum.operators.features import explode_top_topics, refresh_features, with_topic_features
from rostrum.schema import (
    TOPIC_COLUMNS,
    nan_to_null,
    to_published_names,
    to_spark_names,
    topic_columns,
    topic_display_name,
    topic_file_name,
)

WEIGHTS = "tw_a double, tw_b double, tw_c double"


def one_column(spark, values, dtype="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {dtype}")


def mapped(spark, values, expression, dtype="string"):
    df = one_column(spark, values, dtype)
    return [r[0] for r in df.select(expression(F.col("x")).alias("y"), "i").orderBy("i").collect()]


@pytest.mark.parametrize(
    "weights, dominant, highest, entropy, active",
    [
        ((0.5, 0.5, 0.0), "tw_a", 0.5, 0.693147, 2),
        ((0.2, 0.7, 0.1), "tw_b", 0.7, 0.801819, 3),
        ((None, 0.1, 0.9), "tw_c", 0.9, None, 2),
        ((None, None, None), None, None, None, 0),
        ((0.0, 0.0, 0.0), "tw_a", 0.0, 0.0, 0),
        ((0.4, None, 0.4), "tw_a", 0.4, None, 2),
        ((0.01, 0.0100001, None), "tw_b", 0.0100001, None, 1),
    ],
)
def test_topic_features(spark, weights, dominant, highest, entropy, active):
    row = with_topic_features(spark.createDataFrame([weights], WEIGHTS)).first()
    assert (row.dominant_topic, row.max_topic_weight) == (dominant, highest)
    assert row.active_topic_count == active
    if entropy is None:
        assert row.topic_entropy is None
    else:
        assert row.topic_entropy == pytest.approx(entropy, abs=1e-6)


def test_single_topic_and_no_topic(spark):
    single = with_topic_features(spark.createDataFrame([(0.3,)], "tw_only double")).first()
    assert (single.dominant_topic, single.max_topic_weight) == ("tw_only", 0.3)
    plain = spark.createDataFrame([(1,)], "x int")
    assert with_topic_features(plain).columns == ["x"]


def test_entropy_of_all_topics_is_at_most_ln_25(spark):
    even = spark.createDataFrame(
        [tuple([0.04] * 25)], ", ".join(f"{c} double" for c in TOPIC_COLUMNS)
    )
    assert with_topic_features(even).first().topic_entropy == pytest.approx(math.log(25), abs=1e-6)


def test_refresh_replaces_features(spark):
    df = with_topic_features(spark.createDataFrame([(0.2, 0.7, 0.1)], WEIGHTS))
    changed = refresh_features(df.withColumn("tw_a", F.lit(0.9)))
    assert changed.first().dominant_topic == "tw_a"
    assert changed.columns.count("dominant_topic") == 1


def test_top_topics_break_ties_by_column_order_and_skip_zero(spark):
    df = spark.createDataFrame([("d", 0.2, 0.2, 0.0)], "doc_id string, " + WEIGHTS)
    assert rows(explode_top_topics(df, 3).select("rank", "topic", "weight")) == [
        (1, "tw_a", 0.2),
        (2, "tw_b", 0.2),
    ]


def test_names():
    assert topic_display_name("tw_banking_and_finance") == "Banking And Finance"
    assert topic_file_name("tw.civil.rights") == "civil_rights"
    assert len(TOPIC_COLUMNS) == 25 and TOPIC_COLUMNS[0] == "tw_latent1"


def test_dotted_columns_round_trip(spark):
    df = spark.createDataFrame([("x", 0.5)], "`doc.id` string, `tw.economy` double")
    plain = to_spark_names(df)
    assert plain.columns == ["doc_id", "tw_economy"]
    assert topic_columns(plain) == ["tw_economy"]
    assert to_published_names(nan_to_null(plain)).columns == ["doc.id", "tw.economy"]


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert [r.x for r in nan_to_null(df).collect()] == [None, 1.0]


def test_normalize_space(spark):
    values = [
        "   a  b\t\n c　",
        "a\x1cb\x1dc\x1ed\x1fe\x85f\x0bg\x0ch",
        "",
        " \n ",
    ]
    assert mapped(spark, values, tx.normalize_space) == ["a b c", "a b c d e f g h", "", ""]


def test_word_count(spark):
    values = ["", "   ", "a  b", "　x", "one\ntwo three ", None]
    assert mapped(spark, values, tx.word_count) == [0, 0, 2, 1, 3, None]


def test_length_counts_code_points(spark):
    assert mapped(spark, ["a\U0001f600"], F.length) == [2]


@pytest.mark.parametrize("n", [0, 1, 2, 5, 10, 250])
def test_at_least_equals_length_of_normalised_text(spark, n):
    values = [
        "", " ", "a", " a ", "a b", "a  b", " a\n\nb ", "a b c", "abcdefghi", "abcdefghij",
        "a b c d e", "a b  c\td e f ", "　　 ab", "x" * 249, "x" * 250, "y " * 130, "ab" * 3 + " " * 20,
    ]
    got = mapped(spark, values, lambda c: tx.at_least(c, n))
    plain = [len(" ".join(v.split())) for v in values]
    assert got == [length >= n for length in plain]


def test_at_least_on_missing_text(spark):
    assert mapped(spark, [None], lambda c: tx.at_least(c, 10)) == [False]


def test_length_class(spark):
    values = [0, 99, 100, 499, 500, 1999, 2000, 4999, 5000, None]
    assert mapped(spark, values, tx.length_class, "int") == [
        "very_short", "very_short", "short", "short", "medium", "medium", "long", "long",
        "very_long", None,
    ]


def test_parse_date(spark):
    values = ["2004-01-05", "2004-1-5", "bad", "2004-13-05", "2004-02-30", None]
    day = dt.date(2004, 1, 5)
    assert mapped(spark, values, parsing.parse_date) == [day, day, None, None, None, None]


def test_date_parts(spark):
    df = spark.createDataFrame([("2004-12-31",), ("n/a",)], "date string")
    parts = cleaning.standardize_dates(df).select("year", "month", "day_of_year", "decade")
    assert rows(parts) == [(2004, 12, 366, 2000), (None, None, None, None)]


def test_dates_and_numbers_of_other_types(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2004, 1, 5, 13), dt.date(2004, 1, 5), 110, float("nan"), "1e2")],
        "t timestamp, d date, n bigint, x double, s string",
    )
    row = df.select(
        *[parsing.date_column(df, c).alias(c) for c in ("t", "d")],
        *[parsing.number_column(df, c).alias(c) for c in ("n", "x", "s")],
    ).first()
    assert tuple(row) == (dt.date(2004, 1, 5), dt.date(2004, 1, 5), 110.0, None, 100.0)
    again = cleaning.standardize_dates(cleaning.standardize_dates(df.withColumn("date", F.col("t"))))
    assert again.first().year == 2004


def test_parse_number(spark):
    values = [" 110 ", "1e2", "abc", "", "1d", "2f", "NaN", None]
    assert mapped(spark, values, parsing.parse_number) == [
        110.0, 100.0, None, None, None, None, None, None,
    ]


def test_clip_and_fill_weights(spark):
    df = spark.createDataFrame([(1.5,), (-1.0,), (None,), (0.25,)], "tw_a double")
    assert [r.tw_a for r in cleaning.clean_numbers(df).collect()] == [1.0, 0.0, None, 0.25]
    assert [r.tw_a for r in cleaning.fill_weights(df).collect()] == [1.5, -1.0, 0.0, 0.25]


def test_training_flag(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,), ("0",)], "training_set string")
    assert [r.training_set for r in cleaning.clean_numbers(df).collect()] == [1, 0, 0, 0]


def test_mode_fill_takes_the_smallest_on_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "legis_body string")
    filled = [r.legis_body for r in cleaning.fill_categories(df).collect()]
    assert filled == ["b", "a", "b", "a", "a"]


def test_mode_fill_without_any_value(spark):
    df = spark.createDataFrame([(None,)], "legis_body string")
    assert cleaning.fill_categories(df).first().legis_body == "unknown"


def test_ids(spark):
    df = spark.createDataFrame([(None,), ("nan",), ("7",)], "doc_id string")
    assert [r.doc_id for r in cleaning.fill_ids(df).collect()] == ["", "", "7"]


def test_short_texts_are_dropped(spark):
    df = spark.createDataFrame([("a" * 9,), ("a" * 10,), (" a b  ",), (None,)], "text string")
    assert [r.text for r in cleaning.clean(df).collect()] == ["a" * 10]


def test_clean_switches(spark):
    df = spark.createDataFrame([(" x  y ", "2004-01-05")], "text string, date string")
    kept = cleaning.clean(df, fix_dates=False, standardize=False, handle_missing=False)
    assert rows(kept) == [(" x  y ", "2004-01-05")]


def test_features_stay_raw_after_cleaning(spark):
    df = with_topic_features(spark.createDataFrame([(1.5, 0.2, None)], WEIGHTS))
    cleaned = cleaning.clean(df)
    assert cleaned.first().max_topic_weight == 1.5
    assert refresh_features(cleaned).first().max_topic_weight == 1.0


def test_observed_clean_counts_rows(spark):
    df = spark.createDataFrame([("short",), ("long enough text",)], "text string")
    cleaned, before, after = cleaning.clean_observed(df)
    assert cleaned.count() == 1
    assert (before.get["original_size"], after.get["final_size"]) == (2, 1)


def test_cleaning_report(spark):
    df = spark.createDataFrame(
        [("a" * 12, "bad", 99, 1.5), ("a" * 12, "2004-01-05", 110, None), ("x", None, 1, -1.0)],
        "text string, date string, congno bigint, tw_a double",
    )
    report = dict(rows(cleaning.cleaning_report(df)))
    assert report == {
        "original_size": 3, "final_size": 2, "removed": 1, "invalid_dates": 1,
        "invalid_congress": 1, "empty_text_documents": 0, "zero_weight_documents": 1,
        "clipped_tw_a": 1,
    }


def test_conditions(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,), (float("nan"),)], "x double")
    wanted = {"eq": [2.0], "gt": [3.0], "ge": [2.0, 3.0], "lt": [1.0], "le": [1.0, 2.0]}
    for condition, values in wanted.items():
        spec = {"column": "x", "condition": condition, "value": 2.0}
        assert [r.x for r in select.where_spec(df, spec).collect()] == values


def test_unknown_column_and_condition(spark):
    df = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(ValueError, match="no column"):
        predicates.compare(df, {"column": "y", "value": 1})
    with pytest.raises(ValueError, match="unknown condition"):
        predicates.compare(df, {"column": "x", "condition": "ne", "value": 1})


def test_weight_at_the_bound(spark):
    df = spark.createDataFrame([("d", 0.1)], "doc_id string, tw_healthcare double")
    assert select.where_topic(df, "tw.healthcare").count() == 1
    spec = predicates.standard_filters(df.columns)["healthcare_focused"]
    assert select.where_spec(df, spec).count() == 0


def test_failing_custom_filter_is_reported(spark):
    df = spark.createDataFrame([("US House",)], "legis_body string")
    usable, failed = select.merged_filters(df, {"bad": {"column": "nope", "value": 1}})
    assert set(usable) == {"house_only", "senate_only"} and list(failed) == ["bad"]


def test_projection_warns_and_keeps_all(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.warns(UserWarning, match="columns not found"):
        assert select.project(df, ["a", "z"]).columns == ["a"]
    with pytest.warns(UserWarning):
        assert select.project(df, ["z"]).columns == ["a", "b"]
    with pytest.warns(UserWarning):
        assert select.project(df, ["z"], keep_all_if_none=False).columns == []


def test_filter_on_missing_column_warns(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.warns(UserWarning, match="not found"):
        assert select.where_columns(df, {"zzz": lambda c: c > 1}).count() == 1


def test_python_predicate_equals_column_predicate(spark):
    df = spark.createDataFrame([(109, "a"), (110, None), (None, "bb")], "congno int, s string")
    by_column = select.where_columns(df, {"congno": lambda c: c >= 110})
    by_python = select.where_columns(df, {"congno": lambda x: x >= 110}, python=True)
    assert rows(by_column) == rows(by_python) == [(110, None)]
    missing = select.where_columns(df, {"s": lambda x: x is None}, python=True)
    assert rows(missing) == [(110, None)]


def test_unknown_topics(spark):
    df = spark.createDataFrame([("d", 0.5)], "doc_id string, tw_a double")
    with pytest.raises(ValueError):
        select.where_topic(df, "tw_b")
    with pytest.raises(ValueError):
        select.topic_subsets(df)
    assert list(select.topic_subsets(df, ["tw.a", "tw.b"])) == ["a"]


def test_split_by_gives_null_its_own_part(spark):
    df = spark.createDataFrame([("x", 1), (None, 2), ("x", 3)], "k string, v int")
    parts = {k: sorted(r.v for r in p.collect()) for k, p in select.split_by(df, "k").items()}
    assert parts == {"x": [1, 3], None: [2]}


def test_date_range_on_loose_text_and_on_dates(spark):
    df = spark.createDataFrame([("2004-1-5",), ("2004-11-05",), ("n/a",)], "date string")
    assert rows(select.in_date_range(df, "2004-01-01", "2004-06-30")) == [("2004-1-5",)]
    parsed = cleaning.standardize_dates(df).select("date")
    assert select.in_date_range(parsed, "2004-01-01", "2004-12-31").count() == 2


def test_display_name_column(spark):
    assert mapped(spark, ["tw_law_courts_and_judges"], tf.display_name) == ["Law Courts And Judges"]
