"""Toxicity: savings under two dictionaries, held-out accuracy, odd rows."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from rostrum.llm.toxicity import _compressors, _groups, features, fit, score, score_text, train, windows_of

VOCABULARY = ["".join(random.Random(i).choices("abcdefgh", k=6)) for i in range(300)]


def texts(n, seed):
    rng = random.Random(seed)
    out, labels = [], []
    for i in range(n):
        words = rng.choices(VOCABULARY, k=rng.randint(40, 120))
        if i % 6 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["wretched", "vermin!", "Scoundrel"]))
        out.append(" ".join(words))
        labels.append(int(i % 6 == 0))
    return out, labels


@pytest.fixture(scope="module")
def model():
    return fit(*texts(600, 1))


def test_windows():
    assert windows_of("One, TWO three-4 é", 2) == [b"one two", "three é".encode()]
    assert windows_of("") == windows_of("12 ?!") == []


def test_dictionaries_differ_in_their_first_part_alone(model):
    assert len(model.toxic) == len(model.ordinary)
    assert b"wretched" in model.toxic and b"wretched" not in model.ordinary
    assert model.toxic.endswith(model.lead) and model.ordinary.endswith(model.lead)


def test_toxic_windows_save_bytes(model):
    saved = features(model, "wretched vermin scoundrel")
    assert saved[0] >= 5 and saved[1:] == pytest.approx([0, 0, math.log(2), 1, math.log(2)])
    assert features(model, "")[:4] == [0, 0, 0, 0]


def test_features_count_all_windows(model):
    """Every window is compressed for itself and counts, however many there are."""

    def plain(text):
        toxic, ordinary = _compressors(model)
        saved = []
        for window in windows_of(text, model.size):
            framed = model.lead + b" " + window + b" "
            saved.append(len(ordinary.compress(framed)) - len(toxic.compress(framed)))
        many = sum(s >= 3 for s in saved)
        most = sorted(saved, reverse=True) + [0, 0, 0]
        return [*most[:3], math.log1p(many), many / max(1, len(saved)), math.log1p(len(saved))]

    rng = random.Random(7)
    words = rng.choices(VOCABULARY, k=8000)
    few = [*words[:-24], *["vermin"] * 24]
    many = ["wretched vermin scoundrel" if i % 8 == 0 else w for i, w in enumerate(words)]
    for text in ("", "one", " ".join(words), " ".join(few), " ".join(many), "vermin " * 20000):
        assert features(model, text) == pytest.approx(plain(text))
    assert features(model, " ".join(many))[3] > features(model, " ".join(few))[3] + 3


def test_near_copies_are_one_group():
    rng = random.Random(2)
    base = rng.choices(VOCABULARY, k=400)
    other = [*rng.choices(VOCABULARY, k=400), *base[:40]]
    copy = [*base[:200], "changed", *base[201:]]
    assert _groups([" ".join(t) for t in (base, other, copy, base, [])]) == [0, 1, 0, 0, 4]


def test_a_repeated_row_is_learned_from_once(spark, monkeypatch):
    from rostrum.llm import toxicity

    taken = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: taken.append((texts, labels)))
    rows = [(1, "hot text")] * 3000 + [(1, f"other text {i}") for i in range(40)] + [(2, "plain"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0)], "doc_id long, toxic int")
    train(docs, labels)
    train(docs, labels, max_rows=7)
    (texts, labels), (some, _) = taken
    assert len(texts) == 42 and labels.count(0) == 1 and len(some) <= 7


def test_empty_table(spark, documents, model):
    empty = documents([]).drop("score")
    assert score(empty, model).collect() == []
    assert train(empty, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")) is None


def test_unseen_texts(model):
    found, labels = texts(300, 2)
    right = sum((score_text(model, t) >= 0.5) == bool(y) for t, y in zip(found, labels, strict=True))
    assert right >= 0.95 * len(found)


def test_odd_rows_and_columns(spark, documents, model):
    docs = documents([(1, None), (1, ""), (2, "wretched vermin scoundrel"), (None, "x" * 300000), (2, "wretched vermin scoundrel")])
    found = score(docs.drop("score"), model)
    assert found.columns == [*docs.drop("score").columns, "score"]
    rows = found.collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not r.text}) == 1
    replaced = score(docs, model)
    assert sorted(replaced.columns) == sorted(docs.columns)
    assert sorted(r.score for r in replaced.collect()) == sorted(r.score for r in rows)


def test_nothing_to_learn_from(spark, documents):
    docs = documents([(1, "some text"), (2, "other text")]).drop("score")
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1), (9, 1)], "doc_id long, toxic int")
    model = train(docs, labels)
    assert model is None
    assert [r.score for r in score(docs, model).collect()] == [0.0, 0.0]


def test_held_out_accuracy(spark):
    from rostrum.llm.toxicity import op3_toxicity

    found = op3_toxicity(spark, "/root/testdata/sf0.1")
    assert found.count() == 10000
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    sums = found.filter("held_out").join(labels, "doc_id").groupBy("toxic").agg(
        F.avg("score").alias("s"), F.avg("predicted").alias("p")
    )
    means = {r.toxic: (r.s, r.p) for r in sums.collect()}
    assert means[1][0] > means[0][0] + 0.3 and means[0][1] < 0.03 and means[1][1] > 0.4
