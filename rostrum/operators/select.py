"""Projection, filters and topic-focused or per-value subsets."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rostrum.functions.parsing import date_column
from rostrum.functions.predicates import (
    FOCUS_TOPICS,
    FilterSpec,
    between,
    compare,
    python_predicate,
    standard_filters,
)
from rostrum.schema import HIGH_WEIGHT, spark_name, topic_columns, topic_file_name


def project(df: DataFrame, columns: Sequence[str] | None, keep_all_if_none: bool = True) -> DataFrame:
    """Keep the listed columns that exist; warn about the others.

    If none exists the table stays whole, or loses all columns with
    ``keep_all_if_none=False``.
    """
    if not columns:
        return df
    wanted = [spark_name(c) for c in columns]
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        warnings.warn(f"columns not found: {missing}", stacklevel=2)
    available = [c for c in wanted if c in df.columns]
    return df.select(*available) if available or not keep_all_if_none else df


def where_columns(
    df: DataFrame,
    filters: Mapping[str, Callable[[Column], Column]],
    python: bool = False,
) -> DataFrame:
    """AND of one predicate per column; a missing column warns and is skipped.

    Predicates map a Column to a Column and reach the scan. With ``python=True``
    they are plain callables on single values, which run in Arrow batches.
    """
    predicates = []
    for name, predicate in filters.items():
        column = spark_name(name)
        if column not in df.columns:
            warnings.warn(f"filter column {name!r} not found", stacklevel=2)
            continue
        rule = python_predicate(predicate) if python else predicate
        predicates.append(rule(F.col(column)))
    return df.filter(reduce(lambda a, b: a & b, predicates)) if predicates else df


def where_spec(df: DataFrame, spec: FilterSpec) -> DataFrame:
    """One declarative filter, see :func:`rostrum.functions.predicates.compare`."""
    return df.filter(compare(df, spec))


def merged_filters(
    df: DataFrame, custom: Mapping[str, FilterSpec] | None = None
) -> tuple[dict[str, Column], dict[str, str]]:
    """Standard filters with custom ones merged over them.

    Returns the usable predicates and, by name, why the others failed.
    """
    usable, failed = {}, {}
    for name, spec in {**standard_filters(df.columns), **(custom or {})}.items():
        try:
            usable[name] = compare(df, spec)
        except (KeyError, ValueError) as error:
            failed[name] = str(error)
    return usable, failed


def filter_counts(df: DataFrame, custom: Mapping[str, FilterSpec] | None = None) -> DataFrame:
    """``(filter_name, documents)`` for every named filter, in one scan."""
    predicates, _ = merged_filters(df, custom)
    row = df.agg(*[F.count_if(p).alias(name) for name, p in predicates.items()])
    return row.unpivot([], list(predicates), "filter_name", "documents")


def where_topic(df: DataFrame, topic: str, min_weight: float = HIGH_WEIGHT) -> DataFrame:
    """Documents with at least ``min_weight`` on a topic."""
    column = spark_name(topic)
    if column not in topic_columns(df):
        raise ValueError(f"topic {topic!r} not found")
    return df.filter(_at_least(column, min_weight))


def _at_least(column: str, weight: float) -> Column:
    """NaN, which Spark ranks above all numbers, is no weight."""
    return (F.col(column) >= weight) & ~F.isnan(column)


def topic_subsets(
    df: DataFrame, topics: Sequence[str] = FOCUS_TOPICS, min_weight: float = HIGH_WEIGHT
) -> dict[str, DataFrame]:
    """One lazy subset per known topic, by file-safe topic name."""
    known = [spark_name(t) for t in topics if spark_name(t) in topic_columns(df)]
    if not known:
        raise ValueError(f"none of these topics found: {list(topics)}")
    return {topic_file_name(t): where_topic(df, t, min_weight) for t in known}


def topic_memberships(
    df: DataFrame,
    topics: Sequence[str] = FOCUS_TOPICS,
    min_weight: float = HIGH_WEIGHT,
    key: str = "doc_id",
) -> DataFrame:
    """The subsets as one table ``(key, topic, weight)``; a document may repeat."""
    known = [spark_name(t) for t in topics if spark_name(t) in topic_columns(df)]
    if not known:
        raise ValueError(f"none of these topics found: {list(topics)}")
    any_topic = reduce(lambda a, b: a | b, [_at_least(t, min_weight) for t in known])
    long = df.filter(any_topic).select(key, *known).unpivot([key], known, "topic", "weight")
    return long.filter(_at_least("weight", min_weight))


def iterate_split(df: DataFrame, column: str) -> Iterator[tuple[object, DataFrame]]:
    """One value and its lazy subset after another; NULL is a value of its own.

    The values are fetched partition by partition, so a column may have any number.
    ``write.partitionBy(column)`` stores all parts in one scan.
    """
    if column not in df.columns:
        raise ValueError(f"no column {column!r}")
    for row in df.select(column).distinct().toLocalIterator():
        yield row[0], df.filter(F.col(column).eqNullSafe(F.lit(row[0])))


def split_by(df: DataFrame, column: str) -> dict[object, DataFrame]:
    """The subsets of :func:`iterate_split` by value, for a column of few values."""
    return dict(iterate_split(df, column))


def in_congress_range(df: DataFrame, first: int, last: int) -> DataFrame:
    return df.filter(between("congno", first, last))


def in_date_range(df: DataFrame, first: str, last: str) -> DataFrame:
    """Closed range of ISO dates, pushed down on a date column.

    A text column is parsed first, as '2004-1-5' does not sort like a date.
    """
    low, high = F.lit(first).cast("date"), F.lit(last).cast("date")
    return df.filter(date_column(df).between(low, high))
