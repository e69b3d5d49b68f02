"""Declarative filters and the named filters of the speech table."""

from __future__ import annotations

import operator
from collections.abc import Callable, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from rostrum.schema import HIGH_WEIGHT, topic_file_name

CONDITIONS: dict[str, Callable[[Any, Any], Any]] = {
    "eq": operator.eq,
    "gt": operator.gt,
    "ge": operator.ge,
    "lt": operator.lt,
    "le": operator.le,
}

# Topics with a named filter of their own.
FOCUS_TOPICS = ("tw_healthcare", "tw_economy", "tw_defense_and_foreign_policy")

FilterSpec = Mapping[str, Any]


def compare(df: DataFrame, spec: FilterSpec) -> Column:
    """Predicate of ``{"column", "condition", "value"}``; the condition defaults to eq.

    NULL never matches. NaN never matches either: Spark would rank it above all
    numbers, so float columns get a guard.
    """
    column = spec["column"]
    if column not in df.columns:
        raise ValueError(f"no column {column!r}")
    condition = spec.get("condition", "eq")
    if condition not in CONDITIONS:
        raise ValueError(f"unknown condition {condition!r}, use one of {sorted(CONDITIONS)}")
    predicate = CONDITIONS[condition](F.col(column), F.lit(spec["value"]))
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        if condition in ("gt", "ge"):
            predicate = predicate & ~F.isnan(column)
    return predicate


def standard_filters(columns: Sequence[str]) -> dict[str, FilterSpec]:
    """The named filters whose column exists."""
    # Names, columns and bounds of the named filters.
    specs: dict[str, FilterSpec] = {
        "house_only": {"column": "legis_body", "value": "US House"},
        "senate_only": {"column": "legis_body", "value": "US Senate"},
        "recent_congress": {"column": "congno", "condition": "ge", "value": 110},
        "congress_108": {"column": "congno", "value": 108},
        "congress_109": {"column": "congno", "value": 109},
        "training_only": {"column": "training_set", "value": 1},
        "test_only": {"column": "training_set", "value": 0},
    }
    for topic in FOCUS_TOPICS:
        specs[f"{topic_file_name(topic)}_focused"] = {
            "column": topic,
            "condition": "gt",
            "value": HIGH_WEIGHT,
        }
    return {name: spec for name, spec in specs.items() if spec["column"] in columns}


def between(column: str, low: Any, high: Any) -> Column:
    """Closed range; pushed to the Parquet scan as two comparisons."""
    return F.col(column).between(low, high)


def python_predicate(function: Callable[[Any], bool]) -> Callable[[Column], Column]:
    """Wrap a Python callable on single values as a column predicate.

    Arrow-batched, but opaque to the optimizer: it is not pushed to the scan.
    The callable sees missing numbers as NaN and other missing values as ``None``.
    """

    @F.pandas_udf(T.BooleanType())
    def mask(values: pd.Series) -> pd.Series:
        return values.map(lambda v: bool(function(v))).astype(bool)

    return mask
