"""Operators of a training-data pipeline and their registered queries.

Nothing outside this package imports it; the entry point adds its queries only where
the package can be imported.
"""

from __future__ import annotations

from rostrum.llm.registry import oracles, queries

__all__ = ["oracles", "queries"]
