"""Helpers that test modules import; fixtures are in ``conftest``."""

from __future__ import annotations


def rows(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]
