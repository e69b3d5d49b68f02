"""Toxicity by compression distance: which dictionary shortens a text's windows more.

Two zstandard dictionaries differ only in their first part: one begins with the words that
toxic training texts have far more often than ordinary ones, the other with common words
of ordinary texts. Both go on with the same passages, which zstandard's trainer picks from
ordinary texts, so an ordinary window compresses alike under both. A window of a few words
is compressed under each; the bytes the toxic dictionary saves say how toxic it is. The
largest savings of a text's windows give its score through a logistic curve fitted to the
training labels, whose middle is the threshold.
"""

from __future__ import annotations

import random
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from rostrum.llm.common import remainder, sliced, table, texts_of
from rostrum.llm.registry import query

# Words of a window.
WINDOW = 8
# Labelled rows that are learned from, and the longest text among them: what the driver holds.
TRAINING_ROWS = 12_000
TRAINING_TEXT = 64 << 10
# A word belongs to the toxic dictionary if at least so many texts have it, so many
# standard deviations more of the toxic ones than chance gives, and so many times their share.
LEAST_TEXTS, LEAST_DEVIATIONS, LEAST_RATIO = 5, 10.0, 10
OWN_BYTES, COMMON_BYTES = 8 << 10, 8000
# Windows of ordinary texts that zstandard's trainer sees.
SAMPLES = 60_000
# A window counts as toxic from so many bytes saved on.
LEAST_SAVED = 3

# A-Z in lower case, other letters' bytes as they are, anything else separates words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def _words(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


def windows_of(text: str, size: int = WINDOW) -> list[bytes]:
    words = _words(text)
    return [b" ".join(words[i : i + size]) for i in range(0, len(words), size)]


@dataclass(frozen=True)
class Model:
    """Two dictionaries of equal length, the text ahead of every window, and the curve."""

    toxic: bytes
    ordinary: bytes
    lead: bytes
    weights: tuple[float, ...]
    size: int = WINDOW


@lru_cache(maxsize=2)
def _compressors(model: Model) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
    settings = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_GREEDY,
        min_match=5,
        window_log=15,
        hash_log=14,
        chain_log=14,
        search_log=4,
        target_length=32,
        write_content_size=False,
        write_checksum=False,
        write_dict_id=False,
    )
    pair = []
    for content in (model.toxic, model.ordinary):
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(compression_params=settings)
        pair.append(zstandard.ZstdCompressor(compression_params=settings, dict_data=data))
    return pair[0], pair[1]


def savings(model: Model, windows: list[bytes]) -> np.ndarray:
    """Bytes that the toxic dictionary saves on every window.

    The lead, which both dictionaries hold, makes every window long enough for zstandard
    to code it instead of storing it.
    """
    toxic, ordinary = _compressors(model)
    framed = [model.lead + b" " + window + b" " for window in windows]
    return np.array([len(ordinary.compress(f)) - len(toxic.compress(f)) for f in framed], dtype=np.int64)


def features(model: Model, text: str) -> list[float]:
    """The three largest savings, how many windows save enough and their share, the length."""
    windows = windows_of(text, model.size)
    saved = np.sort(savings(model, windows))[::-1]
    most = [*saved[:3].tolist(), 0, 0, 0][:3]
    many = int(np.count_nonzero(saved >= LEAST_SAVED))
    return [*map(float, most), float(np.log1p(many)), many / max(1, len(saved)), float(np.log1p(len(saved)))]


def score_text(model: Model, text: str) -> float:
    weights = np.array(model.weights)
    return float(1 / (1 + np.exp(-(weights[0] + weights[1:] @ np.array(features(model, text))))))


def _groups(texts: list[str], seeds: int = 6) -> list[int]:
    """For every text the first one it is a near copy of, or itself.

    Near copies have most of their smallest word-pair hashes in common with one text; texts
    that merely share a passage have not.
    """
    first: list[dict[int, int]] = [{} for _ in range(seeds)]
    of = []
    for i, text in enumerate(texts):
        words = _words(text)
        pairs = {a + b" " + b for a, b in zip(words, words[1:], strict=False)} or set(words)
        smallest = [min((zlib.crc32(p, s) for p in pairs), default=0) for s in range(seeds)]
        met = Counter(own[value] for own, value in zip(first, smallest, strict=True) if value in own)
        like, times = max(met.items(), key=lambda x: (x[1], -x[0]), default=(i, 0))
        of.append(like if 3 * times >= 2 * seeds else i)
        for own, value in zip(first, smallest, strict=True):
            own.setdefault(value, of[-1])
    return of


def _toxic_words(texts: list[str], labels: list[int]) -> list[bytes]:
    """Words far more frequent in toxic texts, the most telling first; near copies count once."""
    counts = (Counter(), Counter())
    totals = [0, 0]
    for i, first in enumerate(_groups(texts)):
        if i == first:
            counts[labels[i]].update(set(_words(texts[i])))
            totals[labels[i]] += 1
    ordinary, toxic = totals
    ranked = []
    for word, n in counts[1].items():
        other = counts[0][word]
        share = (n + other) / (ordinary + toxic)
        if n < LEAST_TEXTS or share == 1 or n * ordinary < LEAST_RATIO * other * toxic:
            continue
        spread = (toxic * share * (1 - share) * max(ordinary, 1) / (ordinary + toxic)) ** 0.5
        if (above := (n - toxic * share) / spread) >= LEAST_DEVIATIONS:
            ranked.append((above, word))
    return [word for _, word in sorted(ranked, reverse=True)]


def _joined(words: list[bytes], size: int) -> bytes:
    out = b" "
    for word in words:
        if len(out) + len(word) + 1 <= size:
            out += word + b" "
    return out.ljust(size)


def _fit_curve(rows: np.ndarray, labels: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton's method, slightly damped."""
    x = np.c_[np.ones(len(rows)), rows]
    weights = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (labels - p) - 1e-2 * weights
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        weights = weights + np.linalg.solve(curve, slope)
    return tuple(float(w) for w in weights)


def fit(texts: list[str], labels: list[int], size: int = WINDOW, seed: int = 42) -> Model | None:
    """Dictionaries and curve from labelled texts; None unless both labels occur."""
    if len(set(labels)) < 2:
        return None
    toxic = _toxic_words(texts, labels)
    common: Counter = Counter()
    samples: list[bytes] = []
    picked = random.Random(seed)
    ordinary = [t for t, label in zip(texts, labels, strict=True) if not label]
    each = max(1, SAMPLES // max(1, len(ordinary)))
    for text in ordinary:
        common.update(_words(text))
        windows = windows_of(text, size)
        samples += picked.sample(windows, min(each, len(windows)))
    frequent = [w for w, _ in sorted(common.items(), key=lambda x: (-x[1], x[0]))[:4000]]
    picked.shuffle(samples)
    try:
        trained = zstandard.train_dictionary(2 * COMMON_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too little text for the trainer
        trained = b" ".join(samples)
    lead = b" ".join(frequent[:16])
    room = min(OWN_BYTES, sum(len(w) + 1 for w in toxic) + 2)
    both = trained[-COMMON_BYTES:] + lead
    model = Model(_joined(toxic, room) + both, _joined(frequent, room) + both, lead, (), size)
    rows = np.array([features(model, t) for t in texts], dtype=float)
    weights = _fit_curve(rows, np.array(labels, dtype=float))
    return Model(model.toxic, model.ordinary, lead, weights, size)


def train(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    max_rows: int = TRAINING_ROWS,
    max_text: int = TRAINING_TEXT,
) -> Model | None:
    """Fit on at most ``max_rows`` labelled texts, chosen by a hash of their key.

    Rows without text, key or a label of 0 or 1, and texts over ``max_text`` bytes, are
    not learned from; a key, or a text of several rows, with several labels counts as toxic
    if one says so. Equal texts count once, so a repeated row weighs no more than another.
    """
    known = (
        labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias("label"))
        .filter("key IS NOT NULL AND label IN (0, 1)")
        .groupBy("key")
        .agg(F.max("label").alias("label"))
    )
    share = min(1.0, max_rows / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    rows = (
        texts.filter(F.octet_length("text") <= max_text)
        .join(F.broadcast(chosen), "key")
        .groupBy(F.sha2("text", 256).alias("digest"))
        .agg(F.max("label").alias("label"), F.min("text").alias("text"))
        .orderBy("digest")
        .limit(max_rows)
        .collect()
    )
    return fit([r["text"] for r in rows], [r["label"] for r in rows])


def score(
    docs: DataFrame, model: Model | None, text: str = "text", column: str = "score"
) -> DataFrame:
    """Adds the toxicity score, 0 to 1; all rows and other columns stay.

    A missing text counts as empty and gets the score of a text without windows. Without
    a model the score is 0. A column of that name is replaced.
    """
    docs = docs.drop(column)
    if model is None:
        return docs.withColumn(column, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = docs.sparkSession.createDataFrame([], f"`{column}` double").schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            scores = [score_text(shared.value, t) for t in texts_of(batch, text)]
            arrays = [*batch.columns, pa.array(scores, pa.float64())]
            yield pa.record_batch(arrays, names=[*batch.schema.names, column])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *added]))


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from four fifths of the labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 5) == 0
    model = train(docs.filter(~held_out), table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
