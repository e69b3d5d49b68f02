"""Prefix trie against a plain dictionary of prefixes."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rostrum.llm import prefix_trie as module
from rostrum.llm.prefix_trie import intervals, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, conv string"
COLUMNS = [
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
]


def brute(rows, shared=lambda c: zlib.crc32(str(c).encode()) % 6, group=100):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    whole = {c: tuple(own.get(c - c % group, [])[: shared(c)] + own[c][shared(c) :]) for c in own}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for p, cs in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(cs) - 1) * len(p[-1][1]) if p else 0
            leaves[p[:d]] += not children[p]
    out = []
    for p, cs in members.items():
        listed = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        parent = min(members[p[:-1]]) if p else None
        out.append((min(cs), len(p), parent, len(cs), children[p], leaves[p], saved[p], listed))
    return sorted(out, key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    found = prefix_trie(df, **options)
    assert found.columns == COLUMNS
    return sorted(map(tuple, found.collect()), key=repr)


def table(seed, convs):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(700), convs):
        start = rng.choice([0, 0, 1])
        for t in range(rng.randint(1, 9)):
            text = rng.choice(["hello", "hi", "", None, "bonjour à tous"]) if t < 4 else f"{rng.random()}"
            rows.append((c, start + t, ["user", "assistant", None][t % 2 if rng.random() < 0.9 else 2], text))
    return rows


@pytest.mark.parametrize(("seed", "band", "chunk"), [(1, 512, 1 << 17), (2, 2, 40), (3, 3, 1)])
def test_equals_plain_trie(spark, monkeypatch, seed, band, chunk):
    rows = table(seed, 90)
    # Copies, one very long conversation, its copy, turns without number, ties, repeated rows.
    rows += [(3000 + c, t, "user", f"same {t}") for c in range(40) for t in range(3)]
    rows += [(c, t, "user", f"long {t}") for c in (5001, 5002) for t in range(300)]
    rows += [(6000, None, "user", "none"), (6000, None, "user", "a"), (6000, 1, "b", "x"), (6000, 1, "a", "x")]
    rows += [(6000, 1, "a", "x"), (None, 1, "user", "nobody's"), (-7, 0, "user", "hello")]
    monkeypatch.setattr(module, "CHUNK_TURNS", chunk)
    assert run(spark, rows, band=band) == brute(rows)


def test_other_rules_of_rebuilding(spark):
    rows = table(5, 60)
    found = run(spark, rows, group=10, shared=F.lit(0).cast("long"))
    assert found == brute(rows, shared=lambda c: 0, group=10)


def test_empty_table_and_turnless(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "user", "x")]) == []
    # crc32 of "1" leaves a remainder above 0, so its only turn is replaced by none.
    rows = [(c, 0, "user", "x") for c in range(1, 9)]
    assert run(spark, rows) == brute(rows)
    assert any(r[1] == 0 and r[3] == 8 for r in brute(rows))


def test_intervals_of_candidates():
    """Each distinct prefix once, with all of its members, whatever the lengths."""
    rng = random.Random(8)
    lists = sorted([rng.choice("ab") for _ in range(rng.randint(0, 6))] for _ in range(200))
    names = {}
    sizes = np.array([len(x) for x in lists])
    flat = np.array([names.setdefault(tuple(x[: k + 1]), len(names)) for x in lists for k in range(len(x))])
    at, left, right = intervals(sizes, flat, flat, np.zeros(len(sizes), dtype=np.int64))
    told = {flat[i]: (a, z) for i, a, z in zip(at, left, right)}
    assert len(told) == len(at) == len(names)
    for prefix, name in names.items():
        where = [i for i, x in enumerate(lists) if tuple(x[: len(prefix)]) == prefix]
        assert told[name] == (where[0], where[-1])
