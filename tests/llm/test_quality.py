"""Quality classifier: measures against plain counts, held-out accuracy, odd rows."""

from __future__ import annotations

import math

import pyarrow as pa
import pytest

from rostrum.llm.quality import STRETCH, co_train, keep_good, score_quality, text_measures

TEXTS = [
    "Plain words of a text, with a few marks.\nAnd a second line.",
    "BUY!! NOW!! BUY!! NOW!!",
    "the&&& word*** of### it$$$",
    "same\nsame\nsame\nother",
    "word " * 130,
    "",
    None,
    " \n ",
    "日本語 text 🙂 42",
]


def plain(text):
    text = text or ""
    raw, words = text.encode(), text.split()
    ink = sum(b not in (9, 10, 11, 12, 13, 32) for b in raw)
    letters = sum(chr(b).isalpha() for b in raw if b < 128)
    usual = set(map(ord, ".,;:!?'\"()-"))
    symbols = sum(33 <= b < 127 and not chr(b).isalnum() and b not in usual for b in raw)
    stretches = [words[i : i + STRETCH] for i in range(0, len(words), STRETCH)]
    lines = text.split("\n")

    def share(part, whole):
        return part / whole if whole else math.nan

    return {
        "symbols": share(symbols, ink),
        "exclaimed": share(sum(b in (33, 63) for b in raw), ink),
        "capitals": share(sum(65 <= b <= 90 for b in raw), letters),
        "digits": share(sum(48 <= b <= 57 for b in raw), ink),
        "fresh": share(sum(len(set(s)) for s in stretches), len(words)),
        "word_length": share(ink, len(words)),
        "repeated_lines": 1 - len(set(lines)) / len(lines),
    }


def test_measures_equal_plain_counts():
    found = text_measures(pa.array(TEXTS))
    sliced = text_measures(pa.array(["cut off", *TEXTS]).slice(1))
    for name, values in found.items():
        for text, value, other in zip(TEXTS, values, sliced[name], strict=True):
            expected = plain(text)[name]
            assert math.isnan(expected) and not math.isfinite(value) or value == pytest.approx(expected), (name, text)
            assert value == other or not math.isfinite(value)


def made(spark, n=300):
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        text = f"word{i} of*** some&&& junk### {i}" if bad else f"Ordinary words number {i} in a line of text."
        rows.append((i, text, "en", "dump" if bad and i % 2 else f"src{i % 7}", len(text), "x"))
        if i % 3:
            labels.append((i, 0 if bad else 1))
    rows += [(None, "Ordinary words in a line.", None, None, None, "x"), (n, None, "en", "src1", 0, "x"), (n + 1, "", "en", "src1", -1, "x")]
    rows += [rows[1], rows[1]]
    labels += [(1, None), (None, 1), (2, 7), (10**6, 0), (4, 1), (4, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int")


def test_scores_and_filter(spark):
    docs, labels = made(spark)
    found = score_quality(docs, labels)
    assert found.columns == ["doc_id", "text_score", "meta_score", "score"]
    rows = found.collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.score <= 1 for r in rows)
    wrong = [r for r in rows if r.doc_id is not None and r.doc_id < 300 and (r.score >= 0.5) != (r.doc_id % 5 != 0)]
    assert not wrong
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns
    expected = sorted((r.doc_id or -1) for r in rows if r.score >= 0.5)
    assert sorted((r.doc_id or -1) for r in kept.collect()) == expected


def test_without_both_labels_everything_stays(spark):
    docs, labels = made(spark, 20)
    good = labels.filter("quality = 1")
    assert {r.score for r in score_quality(docs, good).collect()} == {1.0}
    assert keep_good(docs, labels.limit(0)).count() == docs.count()
    assert keep_good(docs.limit(0), labels).collect() == []


def test_views_teach_each_other(spark):
    """The metadata view learns a source that no label covers from the text view's verdicts."""
    rows = [([1], [1], 1)] * 60 + [([2], [2], 0)] * 60 + [([2], [3], None)] * 400 + [([1], [1], None)] * 50
    from rostrum.llm import quality

    full = [([b[0]] + [0] * 6, [m[0], 1, 1], label) for b, m, label in rows]
    table = spark.createDataFrame(full, "text_bins array<int>, meta_bins array<int>, label int")
    alone = co_train(table, rounds=1)
    taught = co_train(table, rounds=2)
    new = table.filter("meta_bins[0] = 3").limit(1)
    before = new.select(alone["odds"]["meta"].alias("o")).first().o
    after = new.select(taught["odds"]["meta"].alias("o")).first().o
    assert after < before - 2
    assert quality.ROUNDS >= 2


def test_held_out_accuracy(spark):
    from rostrum.llm.quality import op2_quality

    found = op2_quality(spark, "/root/testdata/sf0.1").filter("held_out")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = found.join(labels, "doc_id").collect()
    assert sum(r.keep == (r.quality == 1) for r in rows) >= 0.97 * len(rows)
