"""Shared dictionaries of string columns."""

from __future__ import annotations

from rostrum.operators.dictionaries import build_dictionary, category_columns, decode, encode

SCHEMA = "id long, a string, `b.c` string, d string"
ROWS = [(1, "x", "p", "1"), (2, "y", None, "2"), (3, "x", "p", "3"), (4, None, "", "4"), (5, "x", "q", "5"),
        (6, "y", "p", "6"), (6, "y", "p", "6")]


def test_share_of_distinct_values(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    # d has 6 values in 7 rows, b.c has 3.
    assert category_columns(df) == ["a", "b.c"]
    assert category_columns(df, share=3 / 7) == ["a"]
    assert category_columns(df, ["d"], share=1.0) == ["d"]
    assert category_columns(df.limit(0)) == [] == category_columns(df.select("id"))


def test_codes_and_back(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    columns = ["a", "b.c"]
    words = build_dictionary(df, columns)
    assert sorted(map(tuple, words.collect())) == [
        ("a", 0, "x"), ("a", 1, "y"), ("b.c", 0, ""), ("b.c", 1, "p"), ("b.c", 2, "q")
    ]
    codes = encode(df, words, columns)
    assert codes.columns == df.columns and codes.schema["a"].dataType.simpleString() == "int"
    got = sorted((tuple(r) for r in codes.collect()), key=str)
    assert got[:4] == [(1, 0, 1, "1"), (2, 1, None, "2"), (3, 0, 1, "3"), (4, None, 0, "4")]
    assert sorted(map(str, decode(codes, words, columns).collect())) == sorted(map(str, df.collect()))


def test_values_that_are_not_listed_and_none_at_all(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    words = build_dictionary(df.filter("a = 'x'"), ["a"])
    assert {r.id: r.a for r in encode(df, words, ["a"]).collect()}[2] is None
    assert build_dictionary(df, []).collect() == [] and encode(df, words, []).count() == len(ROWS)
    assert build_dictionary(df.limit(0), ["a"]).collect() == []
