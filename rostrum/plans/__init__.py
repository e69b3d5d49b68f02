"""Registered queries over the test tables, each with an equivalent SQL text."""

from rostrum.plans.registry import oracles, queries

__all__ = ["oracles", "queries"]
