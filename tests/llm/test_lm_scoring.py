"""The automaton against the closed formula, word by word."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rostrum.llm.lm_scoring import score_texts, walk
from rostrum.llm.packed import bucket_edges, pack, pack_sorted, unpack, unpack_sorted


def tokens_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered) + ["\n"]


def brute(rows, learned, order, strengths):
    counts = Counter()
    for (_, text), learn in zip(rows, learned, strict=True):
        if learn:
            t = tokens_of(text)
            for n in range(1, order + 1):
                counts.update(tuple(t[i : i + n]) for i in range(len(t) - n + 1))
    total = sum(c for g, c in counts.items() if len(g) == 1)
    kinds = sum(len(g) == 1 for g in counts)

    def probability(gram):
        if len(gram) == 1:
            return (counts[gram] + 0.5) / (total + 0.5 * (kinds + 1))
        m = strengths[len(gram) - 2]
        return (counts[gram] + m * probability(gram[1:])) / (counts[gram[:-1]] + m)

    out = []
    for (key, text), learn in zip(rows, learned, strict=True):
        t = tokens_of(text)
        base = sum(math.log10(probability((w,))) for w in t)
        score = sum(math.log10(probability(tuple(t[max(0, i - order + 1) : i + 1]))) for i in range(len(t)))
        out.append((key, learn, len(t), sum(counts[(w,)] > 0 for w in t), total, round(base, 8), round(score, 8)))
    return sorted(out, key=repr)


def rounded(found):
    rows = [tuple(r) for r in found.collect()]
    return sorted(((*r[:5], round(r[5], 8), round(r[6], 8)) for r in rows), key=repr)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_equals_the_formula(documents, order):
    rng = random.Random(order)
    vocabulary = ["a", "B", "cé", "d,", "E\xa0f", "ÀB"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 40)))) for i in range(80)]
    rows += [(None, "a b unheard"), (200, None), (201, ""), (202, " \n\t"), (203, "a " * 4000), (5, "a b"), (5, "a b")]
    learned = [key is None or key % 3 != 1 for key, _ in rows]
    strengths = (3.0, 2.0, 1.5)
    found = score_texts(
        documents(rows),
        learn=F.coalesce(F.col("doc_id") % 3 != 1, F.lit(True)),
        order=order,
        strengths=strengths,
        block_bytes=500,
        bucket_bytes=2000,
    )
    assert found.columns == ["doc_id", "learned", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert rounded(found) == brute(rows, learned, order, strengths)


def test_probabilities_of_next_words_add_up():
    """Over all known words, the end and one unseen word, after any context."""
    rows = [(1, "a b a c"), (2, "b a")]
    lengths = np.array([2])
    counts = Counter(t for _, text in rows for t in tokens_of(text))
    pairs = Counter(p for _, text in rows for p in zip(tokens_of(text), tokens_of(text)[1:]))
    for context in ("a", "b", "c", "zz"):
        total = 0.0
        for word in [*counts, "unseen"]:
            asked = [
                np.array([counts[context], counts[word]], dtype=float),
                np.array([0, pairs[(context, word)]], dtype=float),
            ]
            both = walk(lengths, asked, sum(counts.values()), len(counts), (2.0,))[0]
            alone = walk(np.array([1]), [a[:1] for a in asked], sum(counts.values()), len(counts), (2.0,))[0]
            total += 10 ** (both - alone)
        assert total == pytest.approx(1)


def test_empty_tables(documents):
    assert score_texts(documents([])).collect() == []
    (row,) = score_texts(documents([(1, "a b")]), learn=F.lit(False)).collect()
    assert (row.n_known, row.train_tokens) == (0, 0) and math.isfinite(row.score)
    assert row.score == row.base_score


def test_packed_arrays():
    rng = np.random.default_rng(1)
    for values in (np.zeros(0, np.uint64), rng.integers(0, 1 << 63, 1000).astype(np.uint64)):
        assert (unpack(pack(values)) == values).all()
        assert (unpack_sorted(pack_sorted(np.sort(values))) == np.sort(values)).all()
    edges = bucket_edges(7, 64)
    assert edges[0] == 0 and (np.diff(edges.astype(float)) > 0).all() and len(edges) == 7


def test_held_out_texts_score_better_than_by_words_alone(spark):
    from rostrum.llm.lm_scoring import op1_lm_scoring

    found = op1_lm_scoring(spark, "/root/testdata/sf0.01")
    sums = found.filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.count("*")).first()
    assert sums[2] > 100 and sums[0] > sums[1]
