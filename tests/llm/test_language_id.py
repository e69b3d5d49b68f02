"""Language identification: the rule word by word, held-out accuracy, odd rows."""

from __future__ import annotations

import math

import pytest

from rostrum.llm.language_id import UNDETERMINED, identify, keep_identified, train


@pytest.fixture(scope="module")
def model(spark):
    rows = [
        (1, "the cat and the dog", "en"),
        (2, "le chat et le chien", "fr"),
        (3, "the end", "en"),
        (4, None, "fr"),
        (5, "und", None),
        (6, "", "en"),
    ]
    return train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_known_words_score_their_frequency(model):
    assert model.languages == ["en", "fr"]
    row = model.scores[model.words["the"]]
    assert row[0] == pytest.approx(math.log10(3 / 7)) and row[1] < math.log10(1e-5)
    assert model.scores[model.words["le"]][1] == pytest.approx(math.log10(2 / 5))
    assert "und" not in model.words


def test_unseen_words_back_off_to_the_longest_known_grams(model):
    def plain(word):
        marked = f" {word} "
        for size in range(min(5, len(marked)), 0, -1):
            text = marked if size > 1 else word
            found = [text[i : i + size] for i in range(len(text) - size + 1)]
            known = [model.scores[model.grams[g]] for g in found if g in model.grams]
            if known:
                return sum(known) / len(known)
        return [0.0, 0.0]

    words = ["the", "chiens", "catering", "xd", "zzz", "d"]
    expected = [model.scores[model.words["the"]], *(plain(w) for w in words[1:])]
    for own, other in zip(model.word_scores(words), expected, strict=True):
        assert own == pytest.approx(other)


def test_odd_texts(spark, model):
    texts = [None, "", "123 !?", "THE DOG", "le\x00chien", "the " * 20000, "éé", "the dog"]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    found = {r.doc_id: (r.lang_pred, r.score) for r in identify(rows, model).collect()}
    assert [found[i] for i in (0, 1, 2)] == [(UNDETERMINED, 0.0)] * 3
    assert [found[i][0] for i in (3, 4, 5, 7)] == ["en", "fr", "en", "en"]
    assert found[3] == found[7]
    assert all(0 <= s <= 1 for _, s in found.values())
    replaced = identify(rows.withColumnRenamed("lang", "Score"), model)
    assert replaced.columns == ["doc_id", "text", "lang_pred", "score"]
    assert {r.doc_id: (r.lang_pred, r.score) for r in replaced.collect()} == found


def test_nothing_to_learn_from(spark):
    rows = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    model = train(rows)
    assert [(r.lang_pred, r.score) for r in identify(rows, model).collect()] == [(UNDETERMINED, 0.0)]
    assert train(rows.limit(0)).languages == []


def test_filter_keeps_columns_and_told_rows(documents):
    rows = [(1, "the cat"), (2, "12"), (3, None), (None, "the dog"), (1, "the cat")]
    docs = documents(rows)
    kept = keep_identified(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "the dog"), (1, "the cat"), (1, "the cat")]


def test_held_out_accuracy(spark):
    from rostrum.llm.language_id import op7_language_id

    found = op7_language_id(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").collect()
    assert len(rows) == truth.count()
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)
