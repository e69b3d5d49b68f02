"""Names, plans and SQL texts of the queries of this package."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from rostrum.llm.common import prepare

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_MODULES = (
    "decontamination",
    "lm_scoring",
    "quality",
    "toxicity",
    "order_minhash",
    "url_rules",
    "language_id",
    "token_files",
    "packing",
    "jaccard_join",
    "alignment",
    "exact_search",
    "prefix_trie",
)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where there is one, its SQL text."""

    def register(function: Query) -> Query:
        _QUERIES[name] = lambda spark, sf_dir: function(prepare(spark), sf_dir)
        if sql is not None:
            _ORACLES[name] = sql
        return function

    return register


def _load() -> None:
    for module in _MODULES:
        import_module(f"rostrum.llm.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
