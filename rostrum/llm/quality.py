"""Quality classifier by co-training a text view and a metadata view.

The text view sees shares of marks, capitals, digits and repetitions in the whole text,
the metadata view sees where a document comes from, its language and its stated length.
Each view is a naive Bayes classifier over a few bins per feature, so fitting it is one
aggregation over all rows, and its size does not depend on the data. In every round each
view labels the unlabelled documents it is sure of, by a probability calibrated on the
true labels, and the other view learns from them too. In the end a logistic curve over
both views' odds, fitted to the true labels, scores all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from rostrum.llm.common import HASH_BYTES, remainder, sliced, table
from rostrum.llm.registry import query
from rostrum.session import materialize

ROUNDS = 3
# A view labels a document for the other if it is at least this sure.
SURE = 0.98
# Pseudo-labels count this much of a true label.
TRUST = 0.2
THRESHOLD = 0.5
# Words of a stretch in which repetition is counted.
STRETCH = 50
# Sources and languages are hashed into so many bins.
SOURCES, LANGUAGES = 1024, 128
# Cells of the odds scale on which calibration counts labels.
CELLS, REACH = 64, 16.0

TEXT_CUTS = {
    "symbols": (0.005, 0.01, 0.02, 0.04, 0.08, 0.15, 0.3),
    "exclaimed": (0.002, 0.005, 0.01, 0.02, 0.05, 0.1),
    "capitals": (0.02, 0.05, 0.1, 0.2, 0.4, 0.7),
    "digits": (0.01, 0.03, 0.1, 0.3),
    "fresh": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
    "word_length": (2, 3, 4, 5, 6, 8, 10, 15, 30),
    "repeated_lines": (0.01, 0.1, 0.25, 0.5, 0.75),
}
TEXT_BINS = [len(c) + 2 for c in TEXT_CUTS.values()]
META_BINS = [SOURCES + 1, LANGUAGES + 1, 66]

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:!?'\"()-"]] = True
_UPPER, _LETTER, _DIGIT = (np.zeros(256, dtype=bool) for _ in range(3))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_DIGIT[48:58] = True
_EXCLAIMED = np.zeros(256, dtype=bool)
_EXCLAIMED[[33, 63]] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _sums(mask: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How often the mask holds in each of the consecutive stretches."""
    found = np.zeros(len(sizes), dtype=np.int64)
    filled = sizes > 0
    starts = (np.cumsum(sizes) - sizes)[filled]
    if len(starts):
        found[filled] = np.add.reduceat(mask.view(np.uint8), starts, dtype=np.int64)
    return found


def _distinct(owner: np.ndarray, codes: np.ndarray, owners: int) -> np.ndarray:
    """How many distinct codes each owner has."""
    pairs = np.sort((owner.astype(np.int64) << 32) | codes.astype(np.int64))
    first = np.append(True, pairs[1:] != pairs[:-1]) if len(pairs) else np.zeros(0, bool)
    return np.bincount(pairs[first] >> 32, minlength=owners)


def text_measures(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measures of every text; NaN where a text has nothing to measure."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    n = len(texts)
    begin = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset] if n else 0
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[begin : begin + sizes.sum()]
    ink = sizes - _sums(_SPACE[raw], sizes)
    letters = _sums(_LETTER[raw], sizes)
    # A text of white space alone is split into one empty word.
    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(texts))
    words = pc.list_flatten(lists)
    filled = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    parents = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)[filled]
    counts = np.bincount(parents, minlength=n).astype(np.int64)
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)[filled]
    owner = np.repeat(np.arange(n), counts)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(counts) - counts, counts)
    stretches = -(-counts // STRETCH)
    first = np.cumsum(stretches) - stretches
    distinct = _distinct(first[owner] + place // STRETCH, codes, int(stretches.sum()))
    fresh = np.bincount(np.repeat(np.arange(n), stretches), weights=distinct, minlength=n)
    lines = pc.split_pattern(texts, "\n")
    line_counts = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    line_codes = pc.list_flatten(lines).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    own_lines = _distinct(np.repeat(np.arange(n), line_counts), line_codes, n)
    with np.errstate(divide="ignore", invalid="ignore"):
        return {
            "symbols": _sums(_SYMBOLS[raw], sizes) / ink,
            "exclaimed": _sums(_EXCLAIMED[raw], sizes) / ink,
            "capitals": _sums(_UPPER[raw], sizes) / letters,
            "digits": _sums(_DIGIT[raw], sizes) / ink,
            "fresh": fresh / counts,
            "word_length": ink / np.where(ink > 0, counts, 0),
            "repeated_lines": 1 - own_lines / line_counts,
        }


def _text_bins(texts: pa.Array) -> np.ndarray:
    """One bin per measure; 0 where there is none."""
    measures = text_measures(texts)
    return np.stack(
        [
            np.where(np.isfinite(measures[name]), np.digitize(measures[name], cuts) + 1, 0)
            for name, cuts in TEXT_CUTS.items()
        ],
        axis=1,
    ).astype(np.int32)


def _meta_bins(source: Column, lang: Column, n_chars: Column) -> Column:
    def hashed(value: Column, bins: int) -> Column:
        return F.coalesce(F.pmod(F.xxhash64(value.cast("string")), F.lit(bins)) + 1, F.lit(0))

    length = F.when(n_chars > 0, F.floor(F.log2(n_chars.cast("double"))) + 2).when(n_chars <= 0, 1)
    bins = F.array(
        F.when(source.isNull(), 0).otherwise(hashed(source, SOURCES)),
        F.when(lang.isNull(), 0).otherwise(hashed(lang, LANGUAGES)),
        F.least(F.coalesce(length, F.lit(0)), F.lit(65)),
    )
    return bins.cast("array<int>")


def _with_bins(docs: DataFrame, text: str, source: str, lang: str, n_chars: str) -> DataFrame:
    """All rows and columns with ``text_bins`` and ``meta_bins``, which no column is named."""
    added = docs.sparkSession.createDataFrame([], "text_bins array<int>").schema.fields
    schema = StructType([*docs.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text, HASH_BYTES):
            bins = _text_bins(batch.column(batch.schema.get_field_index(text)))
            offsets = np.arange(len(bins) + 1, dtype=np.int32) * bins.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bins.ravel()))
            yield pa.record_batch([*batch.columns, lists], names=[*batch.schema.names, "text_bins"])

    meta = _meta_bins(*(F.col(f"`{c}`") for c in (source, lang, n_chars)))
    return docs.mapInArrow(run, schema).withColumn("meta_bins", meta)


def _odds(bins: str, weights: list[np.ndarray], prior: float) -> Column:
    """Naive Bayes log odds of good quality from an array of bins."""
    total = F.lit(float(prior))
    for i, own in enumerate(weights):
        table_ = F.array(*[F.lit(float(w)) for w in own])
        total = total + F.element_at(table_, F.col(bins)[i] + 1)
    return total


def _fit_bayes(rows: DataFrame, bins: str, sizes: list[int]) -> tuple[list[np.ndarray], float]:
    """Log odds per bin from rows with ``label`` and ``weight``; one aggregation."""
    counts = (
        rows.select("label", "weight", F.posexplode(bins).alias("feature", "bin"))
        .groupBy("feature", "bin", "label")
        .agg(F.sum("weight").alias("n"))
        .collect()
    )
    sums = [np.full((size, 2), 0.5) for size in sizes]
    for r in counts:
        sums[r["feature"]][r["bin"], r["label"]] += r["n"]
    totals = [s.sum(axis=0) for s in sums]
    weights = [np.log(s[:, 1] / t[1]) - np.log(s[:, 0] / t[0]) for s, t in zip(sums, totals, strict=True)]
    n = sums[0].sum(axis=0)
    return weights, float(np.log(n[1] / n[0]))


def _curve(points: np.ndarray, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Logistic regression of good against bad counts at the points; intercept first."""
    x = np.c_[np.ones(len(points)), points]
    weights = np.zeros(x.shape[1])
    n = good + bad
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (good - n * p) - 1e-2 * weights
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        weights = weights + np.clip(np.linalg.solve(curve, slope), -5, 5)
    return weights


def _cell(odds: Column) -> Column:
    return F.floor((F.least(F.greatest(odds, F.lit(-REACH)), F.lit(REACH - 1e-9)) + REACH) * (CELLS / 2 / REACH))


def _calibrate(rows: DataFrame, odds: list[Column]) -> np.ndarray:
    """A logistic curve over the odds, from label counts in cells of their scales."""
    names = [f"c{i}" for i in range(len(odds))]
    cells = rows.filter("label IS NOT NULL").groupBy(*[_cell(o).alias(n) for o, n in zip(odds, names, strict=True)])
    counts = cells.agg(F.sum("label").alias("good"), F.count("label").alias("n")).collect()
    points = np.array([[(r[n] + 0.5) * 2 * REACH / CELLS - REACH for n in names] for r in counts])
    good = np.array([float(r["good"]) for r in counts])
    n = np.array([float(r["n"]) for r in counts])
    return _curve(points.reshape(len(counts), len(odds)), good, n - good)


def _probability(weights: np.ndarray, odds: list[Column]) -> Column:
    total = F.lit(float(weights[0]))
    for weight, view in zip(weights[1:], odds, strict=True):
        total = total + F.lit(float(weight)) * F.least(F.greatest(view, F.lit(-REACH)), F.lit(REACH))
    return 1 / (1 + F.exp(-total))


def co_train(rows: DataFrame, rounds: int = ROUNDS, sure: float = SURE, trust: float = TRUST) -> dict | None:
    """Both views' weights and the curves from rows ``text_bins, meta_bins, label``.

    ``label`` is 1, 0 or NULL. None unless both labels occur.
    """
    found = {r["label"] for r in rows.select("label").distinct().collect()}
    if not {0, 1} <= found:
        return None
    views = {"text": ("text_bins", TEXT_BINS), "meta": ("meta_bins", META_BINS)}
    known = F.when(F.col("label").isNotNull(), F.col("label"))
    taught = {"text": None, "meta": None}
    odds: dict[str, Column] = {}
    curves: dict[str, np.ndarray] = {}
    for _ in range(rounds):
        for name, (bins, sizes) in views.items():
            other = taught[name]
            label = known if other is None else known.when(F.col("label").isNull(), other)
            weight = F.when(F.col("label").isNotNull(), 1.0).otherwise(trust)
            learned = rows.select(bins, label.alias("own"), weight.alias("weight"))
            learned = learned.filter("own IS NOT NULL").withColumnRenamed("own", "label")
            odds[name] = _odds(bins, *_fit_bayes(learned, bins, sizes))
            curves[name] = _calibrate(rows, [odds[name]])
        for name, other in (("text", "meta"), ("meta", "text")):
            p = _probability(curves[other], [odds[other]])
            taught[name] = F.when(p >= sure, 1).when(p <= 1 - sure, 0)
    both = [odds["text"], odds["meta"]]
    return {"odds": odds, "curves": curves, "both": _calibrate(rows, both)}


_COLUMNS = ("key", "text", "source", "lang", "n_chars")


def _binned(docs: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Key and bins of every row."""
    plain = docs.select(*[F.col(f"`{columns[c]}`").alias(c) for c in _COLUMNS])
    return _with_bins(plain, "text", "source", "lang", "n_chars").drop(*_COLUMNS[1:])


def _labelled(
    binned: DataFrame, labels: DataFrame, key: str, label: str, learn: Column | None
) -> DataFrame:
    known = (
        labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias("label"))
        .filter("key IS NOT NULL AND label IN (0, 1)")
        .groupBy("key")
        .agg(F.min("label").alias("label"))
    )
    known = known if learn is None else known.filter(learn)
    return materialize(binned.join(known, "key", "left"), "quality")


def _scores(model: dict | None) -> list[Column]:
    if model is None:
        return [F.lit(1.0).alias(c) for c in ("text_score", "meta_score", "score")]
    odds, curves = model["odds"], model["curves"]
    return [
        _probability(curves["text"], [odds["text"]]).alias("text_score"),
        _probability(curves["meta"], [odds["meta"]]).alias("meta_score"),
        _probability(model["both"], [odds["text"], odds["meta"]]).alias("score"),
    ]


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    lang: str = "lang",
    n_chars: str = "n_chars",
    label: str = "quality",
    learn: Column | None = None,
) -> DataFrame:
    """Key, ``text_score``, ``meta_score`` and ``score`` (good quality, 0 to 1) of every row.

    Labels count where ``learn`` holds, a condition on ``key``; rows without a key, and
    labels other than 0 and 1, teach nothing; a key with several labels has its smallest.
    Missing metadata and empty or missing texts have bins of their own. Repeated rows are
    scored one by one. Unless both labels occur, every score is 1.
    """
    columns = dict(zip(_COLUMNS, (key, text, source, lang, n_chars), strict=True))
    rows = _labelled(_binned(docs, columns), labels, key, label, learn)
    return rows.select(F.col("key").alias(key), *_scores(co_train(rows)))


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    lang: str = "lang",
    n_chars: str = "n_chars",
    label: str = "quality",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The rows that score at least ``threshold``, all columns as they were.

    The model is trained on all rows first, from their bins alone; the texts are then
    measured again where they are, so they are neither shuffled nor stored.
    """
    names = (key, text, source, lang, n_chars)
    binned = _binned(docs, dict(zip(_COLUMNS, names, strict=True)))
    model = co_train(_labelled(binned, labels, key, label, None))
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    place = {name: f"c{docs.columns.index(name)}" for name in names}
    measured = _with_bins(plain, *(place[n] for n in names[1:]))
    kept = measured.filter(_scores(model)[2] >= threshold)
    return kept.select(plain.columns).toDF(*docs.columns)


@query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from four fifths of the labelled ones."""
    scored = score_quality(
        table(spark, sf_dir, "documents"),
        table(spark, sf_dir, "labels"),
        learn=remainder(F.col("key"), 5) != 0,
    )
    return scored.select(
        "doc_id",
        (remainder(F.col("doc_id"), 5) == 0).alias("held_out"),
        "text_score",
        "meta_score",
        "score",
        (F.col("score") >= THRESHOLD).alias("keep"),
    )
