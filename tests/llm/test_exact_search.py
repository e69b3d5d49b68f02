"""Exact search against all products."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rostrum.llm.exact_search import search_block, top_products

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string, number long"


def brute(rows, k):
    whole = []
    for key, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            parts = [math.floor(256 * float(np.float32(x))) for x in v]
            if all(abs(p) < 1 << 26 for p in parts):
                whole.append((key, parts))
    out = []
    for i, (q, a) in enumerate(whole):
        if q is None or q % 50:
            continue
        scores = [
            (-sum(x * y for x, y in zip(a, b)), c is None, c or 0) for j, (c, b) in enumerate(whole) if j != i
        ]
        for rank, (s, none, c) in enumerate(sorted(scores)[:k], 1):
            out.append((q, rank, None if none else c, -s))
    return sorted(out, key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame([(k, v, 1, "x", "y", 3) for k, v in rows], SCHEMA).repartition(4)
    found = top_products(df, F.col("vec_id") % 50 == 0, **options)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, found.collect()), key=repr)


def table(seed, n, dimension):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        scale = rng.choice([0.05, 0.3, 1.0, 1.0, 4.0])
        rows.append((i, [rng.gauss(0, scale / (1 + k)) for k in range(dimension)]))
    return rows


@pytest.mark.parametrize(("seed", "blocks"), [(1, (32768, 4096)), (2, (40, 3))])
def test_equals_all_products(spark, seed, blocks):
    rows = table(seed, 400, 12)
    copy = rows[37][1]
    # Copies, a repeated query, ties, and rows that take no part.
    rows += [(1000 + i, copy) for i in range(120)] + [(50, rows[50][1]), (50, [0.5] * 12), (100, copy)]
    rows += [(2000, None), (2050, [None] * 12), (2100, [float("nan")] * 12), (2150, [float("inf")] + [0.0] * 11)]
    rows += [(2200, []), (2250, [1.0, -1.0]), (None, copy), (None, [9.0] * 12), (2300, [300000.0] + [0.0] * 11)]
    assert run(spark, rows, candidate_rows=blocks[0], query_rows=blocks[1]) == brute(rows, 5)


def test_few_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0, 2.0])]) == []
    assert run(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    rows = [(0, [1.0, 2.0]), (50, [1.0, 2.5]), (3, [-1.0, -2.0])]
    assert run(spark, rows) == brute(rows, 5)


def test_large_numbers_stay_exact(spark):
    rng = random.Random(5)
    rows = [(i, [float(np.float32(rng.uniform(-2e5, 2e5))) for _ in range(8)]) for i in range(120)]
    assert run(spark, rows) == brute(rows, 5)


def test_bounds_spare_products(monkeypatch):
    """Of vectors with falling lengths and a few strong directions, few are multiplied out."""
    rng = np.random.default_rng(3)
    n, dimension = 20000, 48
    spread = 1 / (1 + np.arange(dimension)) ** 2
    raw = np.floor(256 * rng.normal(size=(n, dimension)) * spread * rng.pareto(2, size=(n, 1))).astype("<i4")
    raw = raw[np.argsort(-np.linalg.norm(raw.astype(float), axis=1))]
    length = np.linalg.norm(raw.astype(float), axis=1)
    _, vectors = np.linalg.eigh(raw.T.astype(float) @ raw)
    both = pa.table(
        {
            "number": np.arange(n),
            "key": np.arange(n),
            "parts": [r.tobytes() for r in raw],
            "length": length,
        }
    )
    asked = both.take(np.arange(0, n, 500))
    open_ = asked.append_column("reach", pa.nulls(len(asked), pa.float64())).append_column(
        "reach_key", pa.nulls(len(asked), pa.int64())
    )
    made = []
    einsum = np.einsum
    monkeypatch.setattr(np, "einsum", lambda f, a, b: made.append(len(a)) or einsum(f, a, b))
    found = search_block(both, open_, np.ascontiguousarray(vectors[:, ::-1]), 5)
    assert found.num_rows == 5 * len(asked)
    assert sum(made) < n * len(asked) // 20
    scores = raw[::500].astype(np.int64) @ raw.T.astype(np.int64)
    scores[np.arange(len(asked)), np.arange(0, n, 500)] = -(1 << 40)
    best = -np.sort(-scores, axis=1)[:, :5]
    assert sorted(found["score"].to_pylist()) == sorted(best.ravel().tolist())
