"""String columns of few distinct values as whole-number codes and one stored dictionary.

File formats encode strings per file. A dictionary that all rows share gives codes that hold
across files and runs: dense per column, from 0, in the order of the values.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from rostrum.operators.numbering import number_by_key
from rostrum.session import discard, materialize

# Fixed value: a column is a category if its distinct values are a smaller share of the rows.
CATEGORY_SHARE = 0.5
DICTIONARY = "column string, code int, value string"


def _string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _tall(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, value`` of every row and column."""
    plain = df.select(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(columns)])
    names = F.create_map(*[F.lit(v) for i, c in enumerate(columns) for v in (f"c{i}", c)])
    tall = plain.unpivot([], [f"c{i}" for i in range(len(columns))], "at", "value")
    return tall.select(names[F.col("at")].alias("column"), "value")


def category_columns(
    df: DataFrame, columns: Sequence[str] | None = None, share: float = CATEGORY_SHARE
) -> list[str]:
    """Those of the string columns whose distinct values are a smaller share of the rows.

    Missing values are no value, but their rows count. A table without rows has none. One
    scan; only distinct values of each task are shuffled.
    """
    asked = list(columns) if columns is not None else _string_columns(df)
    if not asked:
        return []
    values = _tall(df, asked).groupBy("column", "value").agg(F.count("*").alias("n"))
    sizes = values.groupBy("column").agg(F.count("value").alias("distinct"), F.sum("n").alias("rows"))
    found = {r["column"] for r in sizes.filter(F.col("distinct") < share * F.col("rows")).collect()}
    return [c for c in asked if c in found]


def build_dictionary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Stored ``column, code, value``: every distinct value of the columns, with its code.

    Values are numbered over range partitions, so that a column of very many passes through
    no single task. Missing values have no code.
    """
    if not columns:
        return df.sparkSession.createDataFrame([], DICTIONARY)
    values = _tall(df, columns).filter("value IS NOT NULL").distinct()
    numbered = number_by_key(values, ["column", "value"], name="__at")
    # A row per column.
    starts = numbered.groupBy("column").agg(F.min("__at").alias("__start"))
    found = numbered.join(F.broadcast(starts), "column").select(
        "column", (F.col("__at") - F.col("__start")).cast("int").alias("code"), "value"
    )
    stored = materialize(found, "dictionary")
    discard(numbered)
    return stored


def _swap(df: DataFrame, dictionary: DataFrame, column: str, given: str, wanted: str) -> DataFrame:
    told = dictionary.filter(F.col("column") == column).select(
        F.col(given).alias("__given"), F.col(wanted).alias("__wanted")
    )
    # Catalyst sends a small dictionary to all tasks; in a shuffled join AQE splits hot values.
    joined = df.join(told, F.col(f"`{column}`") == F.col("__given"), "left")
    return joined.select(
        *[F.col("__wanted").alias(c) if c == column else F.col(f"`{c}`") for c in df.columns]
    )


def encode(df: DataFrame, dictionary: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns' values replaced by their codes; a value that is not listed has none."""
    return reduce(lambda rows, c: _swap(rows, dictionary, c, "value", "code"), columns, df)


def decode(df: DataFrame, dictionary: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Codes replaced by the values they stand for."""
    return reduce(lambda rows, c: _swap(rows, dictionary, c, "code", "value"), columns, df)
