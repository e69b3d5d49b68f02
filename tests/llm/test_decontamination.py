"""Decontamination against a search word by word."""

from __future__ import annotations

import random
import re

import pytest

from rostrum.llm.decontamination import decontaminate, find_hits, judge, words_of


def plain_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, width):
    windows = {}
    for item, text in items:
        w = plain_words(text)
        size = min(width, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(item) if item is not None else "")
    out = []
    for key, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for window, ids in windows.items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    found |= ids
        out.append((key, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(4)
    vocabulary = ["alpha", "Beta", "g4mma", "délta", "eps", "zeta"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 9)))) for i in range(12)]
    items += [(3, "Alpha, beta; ALPHA"), (None, "zeta eps zeta eps"), (50, ""), (51, None), (52, "?!")]
    docs = [(i, " ".join(rng.choices([*vocabulary, "omega", "psi"], k=rng.randint(0, 60)))) for i in range(60)]
    docs += [(None, "alpha-beta_alpha"), (5, None), (5, ""), (7, "ω alpha " * 3000), (8, "alphabeta")]
    docs += [docs[0], docs[0]]
    return docs, items


@pytest.mark.parametrize("slice_bytes", [1 << 20, 40])
def test_equals_brute_force(spark, documents, tables, slice_bytes):
    docs, items = tables
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    plain = documents(docs).drop("hits")
    found = judge(plain, benchmark, width=4, slice_bytes=slice_bytes)
    rows = [(r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in found.collect()]
    assert sorted(rows, key=repr) == brute(docs, items, 4)


def test_removes_documents_or_spans(spark, documents):
    benchmark = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    text = "Before it, one -- TWO (three) four! And after it all the same."
    docs = documents([(1, text), (2, "nothing of it"), (3, None), (4, "one two three four " + "x " * 200)])
    kept = decontaminate(docs, benchmark, width=4)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    cut = decontaminate(docs, benchmark, "spans", width=4)
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[1] == "Before it, ! And after it all the same." and texts[3] is None
    with pytest.raises(ValueError, match="unknown removal"):
        decontaminate(docs, benchmark, "words")


def test_empty_tables_and_taken_names(spark, documents):
    nothing = spark.createDataFrame([], "item_id long, text string")
    docs = documents([(1, "some text")])
    assert [(r.n_hit, r.contaminated) for r in judge(docs, nothing).collect()] == [(0, False)]
    assert decontaminate(documents([]), nothing).collect() == []
    benchmark = spark.createDataFrame([(1, "some")], "item_id long, text string")
    (row,) = find_hits(docs, benchmark).collect()
    assert [tuple(h) for h in row.hits] == [("1", 0, 1)]
    (row,) = judge(docs.withColumnRenamed("score", "n_hit"), benchmark).collect()
    assert (row.n_hit, row.n_words, row.hits) == (1, 2, "y")


def test_words():
    assert [w.decode() for w in words_of("Don't_stop: ÀB 4x\x00é")] == ["don", "t", "stop", "Àb", "4x", "é"]
