"""Reproducible exact-size samples in hash order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rostrum.operators.numbering import first_shuffled

DEFAULT_SEED = 42


def sample_rows(df: DataFrame, n: int, seed: int = DEFAULT_SEED, key: str = "doc_id") -> DataFrame:
    """Exactly n rows without replacement, the whole table if it has no more.

    The sample is the n rows with the smallest ``md5(seed:key)``. It is cut by a
    filter, not by a global sort with limit, so also a sample of many rows never
    passes through one task.
    """
    border = first_shuffled(df, n, seed, key)
    if border is None:
        return df
    inside = df.filter(border.inside)
    if border.edge is None:
        return inside
    return inside.unionByName(border.edge.filter("__first").drop("__first"))


def sample_fraction(df: DataFrame, fraction: float, seed: int = DEFAULT_SEED) -> DataFrame:
    """About the given share of the rows: one pass, no counting job."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def quick_sample(
    df: DataFrame,
    n: int = 1000,
    congress: int | None = None,
    seed: int = DEFAULT_SEED,
    key: str = "doc_id",
) -> DataFrame:
    """A sample for development, optionally of one congress."""
    if congress:
        df = df.filter(F.col("congno") == congress)
    return sample_rows(df, n, seed, key)
