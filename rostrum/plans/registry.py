"""Names, Spark plans and SQL texts of the registered queries."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rostrum.session import tune

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_MODULES = ("topics", "selection", "cleaning", "statistics", "rows", "storage")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where there is one, its SQL text."""

    def register(function: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name!r} exists")
        _QUERIES[name] = lambda spark, sf_dir: function(tune(spark), sf_dir)
        if sql is not None:
            _ORACLES[name] = sql
        return function

    return register


def _load() -> None:
    for module in _MODULES:
        import_module(f"rostrum.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def r6(value: Column | str) -> Column:
    """Doubles for comparison: six places, and 0.0 instead of -0.0."""
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column.cast("double"), 6) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    formula = "round(CAST(`{c}` AS DOUBLE), 6) + 0.0D AS `{c}`"
    return df.selectExpr(*[(formula if c in columns else "`{c}`").format(c=c) for c in df.columns])


def as_long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def as_double(df: DataFrame, *columns: str) -> DataFrame:
    """For integers that may be NULL, which differ between engines otherwise."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})
