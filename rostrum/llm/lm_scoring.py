"""Language-model scoring by a weighted backoff automaton.

The model is a smoothed n-gram model over words. Its states are the seen contexts; an arc
reads a seen word with its log probability, a failure arc leads to the state one word
shorter with the log weight of backing off. A text is read once from left to right: the
state is carried, failure arcs are followed until the word has an arc, and the weights add
up to the text's log probability.

The automaton of a whole corpus fits no machine, so it is built piece by piece. Documents
are taken in blocks. A block counts its distinct n-grams as 64-bit hashes; hash buckets add
up the counts of all blocks and answer each block with the corpus counts of the n-grams it
asked for. That is exactly the part of the automaton its texts can walk through. Hashes
travel as sorted, delta-coded arrays, one row per block and bucket, so nothing is shuffled
per token, a frequent n-gram is one number per block, and no bucket holds a frequent one's
occurrences.

Smoothing is Dirichlet's: p(w | context) = (c(context w) + m * p(w | shorter context)) /
(c(context) + m) with a strength m per order; below it lies p(w) = (c(w) + 0.5) / (N + 0.5
(V + 1)), where V + 1 counts one unseen word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rostrum.llm.common import (
    END,
    HASH_BYTES,
    fan_out,
    freeing,
    mix64,
    remainder,
    sliced,
    table,
    text_bytes,
    word_hashes,
)
from rostrum.llm.packed import bucket_edges, pack, pack_sorted, unpack, unpack_sorted
from rostrum.llm.registry import query
from rostrum.session import materialize

ORDER = 2
# Strength of the shorter context, for orders 2, 3, ...
STRENGTHS = (200.0, 20.0, 10.0)
# Text of a block of documents, and of the corpus per hash bucket.
BLOCK_BYTES = 6 << 20
BUCKET_BYTES = 12 << 20

# Bits of the hash of two and more words; a word's own hash has 64.
BITS = 56
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def ngram_hashes(words: np.ndarray, counts: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 2, 3, ... words: the hash of those that end at a place, and where there are any."""
    place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    found, before = [], words
    for size in range(2, order + 1):
        joined = np.zeros(len(words), dtype=np.uint64)
        joined[1:] = mix64(before[:-1] * _FACTOR + words[1:] + np.uint64(size)) >> np.uint64(64 - BITS)
        found.append((joined, place >= size - 1))
        before = joined
    return found


def _counted(hashes: np.ndarray, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, ascending, and how often each one is learned from."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else order
    sums = np.add.reduceat(learned[order].astype(np.int64), first) if len(first) else first
    return ordered[first], sums


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[tuple]]:
    """Word hashes of the batches in blocks of about ``limit`` bytes of text."""
    parts, size = [], 0
    for batch in sliced(batches, "text", HASH_BYTES):
        parts.append((*word_hashes(batch.column("text"), END), batch.column("key"), batch.column("learn")))
        size += batch.column("text").nbytes
        if size >= limit:
            yield parts
            parts, size = [], 0
    if parts:
        yield parts


def _requests(docs: DataFrame, order: int, buckets: int, block_bytes: int) -> DataFrame:
    """Stored rows of two kinds: a block's n-grams by bucket, and its documents (no bucket)."""
    kind = docs.schema["key"].dataType.simpleString()
    schema = (
        f"block long, bucket int, hashes array<binary>, counts array<binary>, keys array<{kind}>, "
        "learn array<boolean>, lengths binary, words binary, tokens binary"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, parts in enumerate(_blocks(batches, block_bytes)):
            block = (part << 32) + number
            words, lengths = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            keys = pa.concat_arrays([p[2] for p in parts])
            learn = pa.concat_arrays([p[3] for p in parts])
            learned = np.repeat(learn.to_numpy(zero_copy_only=False).astype(bool), lengths)
            counted = [_counted(words, learned)]
            for joined, there in ngram_hashes(words, lengths, order):
                counted.append(_counted(joined[there], learned[there]))
            tokens = np.searchsorted(counted[0][0], words)
            yield _documents_row(block, keys, learn, lengths, counted[0][0], tokens)
            cuts = []
            for k, (hashes, _) in enumerate(counted):
                edges = bucket_edges(buckets, 64 if k == 0 else BITS)
                cuts.append(np.append(np.searchsorted(hashes, edges), len(hashes)))
            rows: dict[str, list] = {"bucket": [], "hashes": [], "counts": []}
            for b in range(buckets):
                spans = [(c[b], c[b + 1]) for c in cuts]
                if any(a < z for a, z in spans):
                    rows["bucket"].append(b)
                    rows["hashes"].append(
                        [pack_sorted(h[a:z]) for (h, _), (a, z) in zip(counted, spans, strict=True)]
                    )
                    rows["counts"].append(
                        [pack(n[a:z]) for (_, n), (a, z) in zip(counted, spans, strict=True)]
                    )
            yield _request_rows(block, rows, keys.type)

    return materialize(docs.mapInArrow(run, schema), "ngrams")


_BINARIES = pa.list_(pa.binary())


def _row_schema(key: pa.DataType) -> pa.Schema:
    return pa.schema(
        [
            ("block", pa.int64()),
            ("bucket", pa.int32()),
            ("hashes", _BINARIES),
            ("counts", _BINARIES),
            ("keys", pa.list_(key)),
            ("learn", pa.list_(pa.bool_())),
            ("lengths", pa.binary()),
            ("words", pa.binary()),
            ("tokens", pa.binary()),
        ]
    )


def _documents_row(block, keys, learn, lengths, words, tokens) -> pa.RecordBatch:
    offsets = pa.array([0, len(keys)], pa.int32())
    columns = [
        pa.array([block]),
        pa.array([None], pa.int32()),
        pa.array([None], _BINARIES),
        pa.array([None], _BINARIES),
        pa.ListArray.from_arrays(offsets, keys),
        pa.ListArray.from_arrays(offsets, learn),
        pa.array([pack(lengths)]),
        pa.array([pack_sorted(words)]),
        pa.array([pack(tokens)]),
    ]
    schema = _row_schema(keys.type)
    return pa.record_batch([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _request_rows(block: int, rows: dict[str, list], key: pa.DataType) -> pa.RecordBatch:
    n = len(rows["bucket"])
    full = {"block": [block] * n, **rows}
    schema = _row_schema(key)
    return pa.record_batch(
        [pa.array(full.get(f.name, [None] * n), type=f.type) for f in schema], schema=schema
    )


def _answers(requests: DataFrame) -> DataFrame:
    """Corpus counts for every block and bucket, and the bucket's share of N and V once."""

    @freeing
    def run(group: pa.Table) -> pa.Table:
        blocks = group["block"].to_pylist()
        hashes, counts = group["hashes"].to_pylist(), group["counts"].to_pylist()
        orders = len(hashes[0])
        answers: list[list[bytes]] = [[] for _ in blocks]
        total = distinct = 0
        for k in range(orders):
            own = [unpack_sorted(h[k]) for h in hashes]
            learned = np.concatenate([unpack(c[k]) for c in counts]).astype(np.int64)
            _, place = np.unique(np.concatenate(own), return_inverse=True)
            sums = np.bincount(place, weights=learned).astype(np.int64) if len(place) else learned
            if k == 0:
                total, distinct = int(sums.sum()), int((sums > 0).sum())
            at = 0
            for answer, h in zip(answers, own, strict=True):
                answer.append(pack(sums[place[at : at + len(h)]]))
                at += len(h)
        rest = [0] * (len(blocks) - 1)
        return pa.table(
            {
                "block": pa.array(blocks, pa.int64()),
                "bucket": group["bucket"].combine_chunks(),
                "counts": pa.array(answers, _BINARIES),
                "total": pa.array([total, *rest], pa.int64()),
                "distinct": pa.array([distinct, *rest], pa.int64()),
            }
        )

    schema = "block long, bucket int, counts array<binary>, total long, distinct long"
    asked = requests.filter("bucket IS NOT NULL").select("block", "bucket", "hashes", "counts")
    return materialize(asked.groupBy("bucket").applyInArrow(run, schema), "counts")


def walk(
    lengths: np.ndarray,
    counts: list[np.ndarray],
    total: int,
    distinct: int,
    strengths: tuple[float, ...],
) -> np.ndarray:
    """Read all texts through the automaton; the log10 probability of each.

    ``counts[k]`` has, for every token, the corpus count of the k + 1 words that end there
    (0 where the text has fewer). A state is a seen context, known by its length and the
    token it ends at; all texts of the block take each step together.
    """
    order = len(counts)
    arcs = [np.log10((counts[0] + 0.5) / (total + 0.5 * (distinct + 1)))]
    failures = [np.zeros(0)]
    for k in range(1, order):
        context = np.append(0, counts[k - 1][:-1])
        m = strengths[k - 1]
        arcs.append(np.log10((counts[k] + m * 10.0 ** arcs[k - 1]) / (context + m)))
        failures.append(np.log10(m / (context + m)))
    starts = np.cumsum(lengths) - lengths
    turn = np.argsort(-lengths, kind="stable")
    begin, left = starts[turn], lengths[turn]
    state = np.zeros(len(lengths), dtype=np.int64)
    score = np.zeros(len(lengths))
    active = len(lengths)
    for step in range(int(left[0]) if len(left) else 0):
        active = int(np.searchsorted(-left[:active], -step, side="left"))
        at, now, sums = begin[:active] + step, state[:active], score[:active]
        for k in range(order - 1, 0, -1):
            failing = np.flatnonzero((now == k) & (counts[k][at] == 0))
            sums[failing] += failures[k][at[failing]]
            now[failing] = k - 1
        weight = arcs[0][at]
        for k in range(1, order):
            weight = np.where(now == k, arcs[k][at], weight)
        sums += weight
        now[:] = np.where(counts[0][at] > 0, np.minimum(now + 1, order - 1), 0)
    scores = np.empty(len(lengths))
    scores[turn] = score
    return scores


def score_texts(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    learn: Column | None = None,
    order: int = ORDER,
    strengths: tuple[float, ...] = STRENGTHS,
    block_bytes: int = BLOCK_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Key, ``learned``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    The model learns from all rows where ``learn`` holds (all rows by default). A missing
    text counts as empty: its end mark is its only token. Rows with missing or repeated
    keys are learned from and scored one by one. Scores are log10 probabilities of the
    whole text; ``base_score`` is that of the words by themselves. Other columns are not
    read. An empty table gives no rows.
    """
    rows = docs.select(
        F.col(f"`{key}`").alias("key"),
        F.col(f"`{text}`").alias("text"),
        F.coalesce(F.lit(True) if learn is None else learn, F.lit(False)).alias("learn"),
    )
    block_bytes, bucket_bytes, buckets = fan_out(text_bytes(docs, text), block_bytes, bucket_bytes)
    kind = rows.schema["key"].dataType.simpleString()
    requests = _requests(rows, order, buckets, block_bytes)
    answers = _answers(requests)
    sums = answers.agg(F.sum("total").alias("total"), F.sum("distinct").alias("distinct")).first()
    total, distinct = sums["total"] or 0, sums["distinct"] or 0

    @freeing
    def run(group: pa.Table) -> pa.Table:
        own = group.filter(pc.is_null(group["bucket"]))
        replies = group.filter(pc.is_valid(group["bucket"])).sort_by("bucket")["counts"].to_pylist()
        lengths = unpack(own["lengths"][0].as_py()).astype(np.int64)
        words = unpack_sorted(own["words"][0].as_py())
        tokens = unpack(own["tokens"][0].as_py()).astype(np.int64)
        answered = [np.concatenate([unpack(r[k]) for r in replies]) for k in range(order)]
        counts = [answered[0].astype(np.float64)[tokens]]
        for k, (joined, there) in enumerate(ngram_hashes(words[tokens], lengths, order), 1):
            _, place = np.unique(joined[there], return_inverse=True)
            counts.append(np.zeros(len(tokens)))
            counts[k][there] = answered[k].astype(np.float64)[place]
        ends = np.cumsum(lengths)
        base = np.log10((counts[0] + 0.5) / (total + 0.5 * (distinct + 1)))
        known = np.append(0, np.cumsum(counts[0] > 0))
        return pa.table(
            {
                "key": pc.list_flatten(own["keys"]).combine_chunks(),
                "learned": pc.list_flatten(own["learn"]).combine_chunks(),
                "n_tokens": pa.array(lengths),
                "n_known": pa.array(known[ends] - known[ends - lengths]),
                "train_tokens": pa.array(np.full(len(lengths), total)),
                "base_score": pa.array(np.add.reduceat(base, ends - lengths)),
                "score": pa.array(walk(lengths, counts, total, distinct, strengths)),
            }
        )

    documents = requests.filter("bucket IS NULL").select(
        "block", "bucket", "counts", "keys", "learn", "lengths", "words", "tokens"
    )
    met = documents.unionByName(answers.drop("total", "distinct"), allowMissingColumns=True)
    scored = met.groupBy("block").applyInArrow(
        run,
        f"key {kind}, learned boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double",
    )
    return scored.withColumnRenamed("key", key)


@query("op1_lm_scoring")
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under a model of four fifths of them."""
    docs = table(spark, sf_dir, "documents")
    scored = score_texts(docs, learn=remainder(F.col("doc_id"), 5) != 1)
    return scored.select(
        "doc_id",
        (~F.col("learned")).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )
