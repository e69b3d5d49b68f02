"""The pipeline stage by stage against plain readings of what each has to keep."""

from __future__ import annotations

import importlib
import sys
import zlib

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from test_decontamination import brute as brute_hits
from test_jaccard_join import brute as brute_components
from test_jaccard_join import shingles
from tokenizers import Tokenizer

from rostrum.llm.language_id import identify, train
from rostrum.llm.quality import score_quality
from rostrum.llm.tokens import vocabulary_path

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == [
        "quality classifier",
        "language ID",
        "n-gram Jaccard join",
        "benchmark decontamination",
        "packing",
    ]


def test_every_stage_does_its_part(spark, tmp_path):
    docs = corpus_pipeline.table(spark, SF, "documents")
    columns = docs.columns
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(k))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        assert k == 4 or docs.columns == columns
        kept.append(docs)
    all_docs = corpus_pipeline.table(spark, SF, "documents")
    by_key = {r.doc_id: r for r in all_docs.collect()}

    def ids(df):
        return sorted(r.doc_id for r in df.select("doc_id").collect())

    scores = score_quality(all_docs, corpus_pipeline.table(spark, SF, "labels"))
    assert ids(kept[0]) == ids(scores.filter("score >= 0.5"))

    told = identify(kept[0], train(kept[0]))
    assert ids(kept[1]) == ids(told.filter("lang_pred != 'und' AND score >= 0.5"))

    before = ids(kept[1])
    sets = {i: shingles(by_key[i].text, 5) for i in before}
    top = {i: i for i in before}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in before:
        for j in before:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    assert ids(kept[2]) == sorted(i for i in before if root(i) == i)

    items = [(r.item_id, r.text) for r in corpus_pipeline.table(spark, SF, "benchmark").collect()]
    judged = brute_hits([(i, by_key[i].text) for i in ids(kept[2])], items, 13)
    assert ids(kept[3]) == sorted(key for key, *_, dirty in judged if not dirty)
    assert len(kept[3].collect()) < len(by_key)

    whole = Tokenizer.from_file(vocabulary_path())
    pieces = {}
    for r in kept[4].collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert sorted(pieces) == ids(kept[3])
    for key, own in pieces.items():
        tokens = whole.encode(by_key[key].text, add_special_tokens=False).ids + [2]
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            part = tokens[r.start : r.start + r.length]
            assert r.start == at and r.doc_tokens == len(tokens)
            assert r.ids_crc32 == zlib.crc32(np.array(part, dtype="<u4").tobytes())
            at += r.length
        assert at == len(tokens)


def test_near_duplicates_by_five_words_and_four_fifths(spark, tmp_path):
    """Copies between 80 and 90 % go, those below stay."""
    rows = []
    for k in range(6):
        words = [f"w{k}x{i}" for i in range(100)]
        rows.append((10 * k, " ".join(words)))
        rows.append((10 * k + 1, " ".join([*words, *[f"more{k}x{i}" for i in range(10 + 4 * k)]])))
        changed = [f"new{k}x{i}" if i % 40 == 20 and i < 40 * (k % 3 + 1) else w for i, w in enumerate(words)]
        rows.append((10 * k + 2, " ".join(changed)))
    schema = "doc_id long, text string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents"))
    docs = spark.read.parquet(str(tmp_path / "documents"))
    expected = {i for i, _, component in brute_components(rows, 5, 80) if i == component}
    assert 6 < len(expected) < 12
    found = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert sorted(r.doc_id for r in found.collect()) == sorted(expected)


def test_run_is_the_stages_in_a_row(spark):
    docs = corpus_pipeline.table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    found = corpus_pipeline.run(spark, SF)
    assert found.columns == [*columns, "sequence_id", "offset"]
    one, other = (sorted(map(tuple, df.select(columns).collect())) for df in (found, docs))
    assert one == other


def test_nulls_and_odd_texts_pass_every_stage(spark, tmp_path):
    rows = [
        (1, "An ordinary text of some words, and a few more of them.", "en", "s", 55),
        (1, "An ordinary text of some words, and a few more of them.", "en", "s", 55),
        (None, "Another ordinary text without a key at all here.", None, None, None),
        (3, None, "en", "s", None),
        (4, "", "en", None, 0),
        (5, "word " * 30000, "en", "s", 150000),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, content in (("some", rows), ("none", [])):
        folder = tmp_path / name
        spark.createDataFrame(content, schema).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([(1, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        spark.createDataFrame([(None, None), (1, "nothing that occurs")], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        found = corpus_pipeline.run(spark, str(folder))
        keys = [r.doc_id for r in found.collect()]
        assert (1 in keys and keys.count(1) == 1) if content else keys == []


def test_entry_lists_the_queries():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert {"pipeline"} | {n for n in names if n.startswith("op")} <= names
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert set(entry.oracle_sql()) <= names
    assert F is not None and "corpus_pipeline" in sys.modules
