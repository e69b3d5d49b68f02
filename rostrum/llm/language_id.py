"""Language identification: words first, then shorter and shorter character n-grams.

Training counts words per language over all labelled documents and keeps those whose share
of a language's words reaches ``min_share``; the shares of a language add up to one, so
1 / min_share bounds the words kept for it. The character n-grams of the words, down to
single letters, are counted and kept alike. A known word scores its log frequency in every
language. An unseen word scores the mean log frequency of its longest n-grams that are
known, and one letter less each time none is.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from rostrum.llm.common import remainder, sliced, table
from rostrum.llm.registry import query
from rostrum.session import materialize

UNDETERMINED = "und"
# Documents whose best language is less likely than this are rejected by the filter.
LEAST_SCORE = 0.5
LONGEST = 5
# Least share of a language's words (of its n-grams of a length) that is remembered.
MIN_SHARE = 2e-5
# Up to this many languages the model has at most 1 / MIN_SHARE words for each; beyond,
# the least share grows in proportion, so that the model never gets larger.
LANGUAGES = 32
# Log10 frequency that a language gets for a word or n-gram only others have, below the
# least share.
FLOOR = -2.0


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-case runs of letters of all texts, and how many each text has."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    spaced = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\pL]+", " ")
    lists = pc.ascii_split_whitespace(pc.ascii_trim(spaced, " "))
    words = pc.list_flatten(lists)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    filled = pc.greater(pc.binary_length(words), 0)
    if not pc.all(filled).as_py():
        parents = pc.list_parent_indices(lists).to_numpy()[filled.to_numpy(zero_copy_only=False)]
        counts = np.bincount(parents, minlength=len(counts)).astype(np.int64)
        words = words.filter(filled)
    return words, counts


def word_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Words per language, ``lang, word, n``, counted in the tasks before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            words, counts = _words(batch.column("text"))
            langs = pc.dictionary_encode(batch.column("lang"))
            owner = np.repeat(langs.indices.to_numpy(zero_copy_only=False), counts)
            for k, name in enumerate(langs.dictionary.to_pylist()):
                found = pc.value_counts(words.filter(pa.array(owner == k)))
                word, n = found.field("values"), found.field("counts")
                yield pa.record_batch(
                    {"lang": pa.repeat(name, len(word)), "word": word.cast(pa.string()), "n": n}
                )

    named = docs.select(
        F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")
    ).filter("lang IS NOT NULL AND text IS NOT NULL")
    counted = named.mapInArrow(count, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _gram_counts(words: DataFrame, longest: int) -> DataFrame:
    """Character n-grams of the words, marked at both ends: ``lang, gram, n``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[str, Counter] = {}
            columns = (batch.column(c).to_pylist() for c in ("lang", "word", "n"))
            for lang, word, n in zip(*columns, strict=True):
                own = sums.setdefault(lang, Counter())
                marked = f" {word} "
                for size in range(1, longest + 1):
                    for i in range(len(marked) - size + 1):
                        own[marked[i : i + size]] += n
            for lang, own in sums.items():
                yield pa.record_batch(
                    {
                        "lang": pa.repeat(lang, len(own)),
                        "gram": pa.array(list(own), pa.string()),
                        "n": pa.array(list(own.values()), pa.int64()),
                    }
                )

    counted = words.mapInArrow(count, "lang string, gram string, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Log frequencies: one row of ``scores`` per known word or n-gram, one column per language."""

    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    scores: np.ndarray
    longest: int

    def _backoff(self, word: str) -> list[int]:
        """The known n-grams of the greatest length that has any."""
        marked = f" {word} "
        get = self.grams.get
        for size in range(min(self.longest, len(marked)), 1, -1):
            grams = (marked[i : i + size] for i in range(len(marked) - size + 1))
            if known := [k for k in map(get, grams) if k is not None]:
                return known
        # The marks of a word's ends alone tell nothing.
        return [k for k in map(get, word) if k is not None]

    def word_scores(self, words: list[str]) -> np.ndarray:
        """One row per word: its log frequencies, or 0 where nothing of it is known."""
        found = np.zeros((len(words), len(self.languages)))
        place = np.fromiter((self.words.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        found[place >= 0] = self.scores[place[place >= 0]]
        unseen = np.flatnonzero(place < 0)
        known = [self._backoff(words[i]) for i in unseen.tolist()]
        sizes = np.fromiter(map(len, known), dtype=np.int64, count=len(known))
        if sizes.sum():
            flat = np.fromiter(chain.from_iterable(known), dtype=np.int64, count=int(sizes.sum()))
            some, sizes = unseen[sizes > 0], sizes[sizes > 0]
            sums = np.add.reduceat(self.scores[flat], np.cumsum(sizes) - sizes, axis=0)
            found[some] = sums / sizes[:, None]
        return found

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and its probability for every text."""
        words, counts = _words(texts)
        if not self.languages:
            return [UNDETERMINED] * len(counts), np.zeros(len(counts))
        distinct = words.dictionary_encode()
        table_ = self.word_scores(distinct.dictionary.to_pylist())
        table_ -= table_.mean(axis=1, keepdims=True)
        place = distinct.indices.to_numpy(zero_copy_only=False)
        ends = np.cumsum(counts)
        sums = np.zeros((len(counts), len(self.languages)))
        for k in range(len(self.languages)):
            running = np.append(0.0, np.cumsum(table_[place, k]))
            sums[:, k] = running[ends] - running[ends - counts]
        best = sums.argmax(axis=1)
        odds = np.power(10.0, np.maximum(sums - sums.max(axis=1, keepdims=True), -300))
        score = np.where(counts > 0, 1 / odds.sum(axis=1), 0.0)
        names = [self.languages[b] if n else UNDETERMINED for b, n in zip(best, counts, strict=True)]
        return names, score


def train(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    longest: int = LONGEST,
    min_share: float = MIN_SHARE,
) -> Model:
    """Learn from all rows with a text and a language.

    Without such rows the model knows no language and predicts ``und``.
    """
    counts = materialize(word_counts(docs, text, lang), "words")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    names = sorted(r["lang"] for r in totals.select("lang").limit(int(1 / min_share)).collect())
    if len(names) >= 1 / min_share:
        raise ValueError("the language column has too many values to be one")
    share = min_share * max(1.0, len(names) / LANGUAGES)
    words = _frequent(counts.withColumnRenamed("word", "item"), totals, share)
    grams = materialize(_gram_counts(counts, longest).withColumnRenamed("gram", "item"), "grams")
    sizes = grams.groupBy("lang", F.length("item").alias("size")).agg(F.sum("n").alias("total"))
    gram_shares = _frequent(grams.withColumn("size", F.length("item")), sizes, share)
    floor = np.log10(share) + FLOOR
    place = {name: k for k, name in enumerate(names)}
    rows: list[np.ndarray] = []

    def learn(frequent: DataFrame) -> dict[str, int]:
        known: dict[str, int] = {}
        for r in frequent.orderBy("item", "lang").collect():
            if r["item"] not in known:
                known[r["item"]] = len(rows)
                rows.append(np.full(len(names), floor))
            rows[known[r["item"]]][place[r["lang"]]] = r["log_share"]
        return known

    word_places, gram_places = learn(words), learn(gram_shares)
    scores = np.vstack(rows) if rows else np.zeros((0, len(names)))
    return Model(names, word_places, gram_places, scores, longest)


def _frequent(counts: DataFrame, totals: DataFrame, share: float) -> DataFrame:
    """Items that reach the share in some language: ``item, lang, log_share`` for all languages."""
    on = [c for c in totals.columns if c != "total"]
    shares = counts.join(F.broadcast(totals), on).withColumn("share", F.col("n") / F.col("total"))
    kept = shares.filter(F.col("share") >= share).select("item").distinct()
    return shares.join(kept, "item", "left_semi").select(
        "item", "lang", F.log10("share").alias("log_share")
    )


def identify(
    docs: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score"
) -> DataFrame:
    """Adds the language and its probability; all rows and other columns stay.

    A text without letters, empty or missing gets ``und`` and 0. Ties go to the first
    language in alphabetic order. Columns that have the names of the added ones are replaced.
    """
    docs = docs.drop(lang, score)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    added = spark.createDataFrame([], f"`{lang}` string, `{score}` double").schema.fields

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            place = batch.schema.get_field_index(text)
            names, scores = shared.value.predict(batch.column(place))
            arrays = [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.record_batch(arrays, names=[*batch.schema.names, lang, score])

    return docs.mapInArrow(predict, StructType([*docs.schema.fields, *added]))


def keep_identified(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: float = LEAST_SCORE
) -> DataFrame:
    """The rows whose language is told with a score of ``least`` or more, as they were.

    The model learns from all rows with a text and a language. Texts without letters go.
    """
    model = train(docs, text, lang)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    found = identify(plain, model, f"c{docs.columns.index(text)}")
    kept = found.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least))
    return kept.select(plain.columns).toDF(*docs.columns)


def held_out(key: str = "doc_id") -> Column:
    return remainder(F.col(key), 4) == 2


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out()))
    found = identify(docs.select("doc_id", "text", held_out().alias("held_out")), model)
    return found.drop("text").select("doc_id", "held_out", "lang_pred", "score")
