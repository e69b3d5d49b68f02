"""Helpers that several operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import string
import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rostrum.session import tune

# Where the C library is glibc, freed memory is kept by the process unless it is asked for.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None

# Text bytes that one task handles at a time; longer single texts are taken alone.
BATCH_BYTES = 4 << 20
# The same where words are only hashed or counted and repeats save little.
HASH_BYTES = 2 << 20
# Rows that Spark sends to Python at once, in place of its default of 10,000: documents
# are long, and both sides hold a batch in memory.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Set run-time options that long texts need, unless the user chose a value."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return tune(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower case for A-Z alone."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def remainder(key: Column, divisor: int) -> Column:
    """crc32 of the key as text, modulo the divisor; -1 for a missing key."""
    crc = F.crc32(key.cast("string").cast("binary"))
    return F.coalesce(F.pmod(crc, F.lit(divisor)).cast("int"), F.lit(-1))


def sliced(batches: Iterable[pa.RecordBatch], text: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Join and cut Arrow batches to about ``limit`` bytes of text each; a longer text is alone."""
    held, size = [], 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = (ends[start - 1] if start else 0) - size
            stop = max(start + (not held), int(np.searchsorted(ends, base + limit, side="right")))
            if stop > start:
                held.append(batch.slice(start, stop - start))
                size = int(ends[stop - 1]) - base
            if stop < batch.num_rows:
                yield _joined(held)
                held, size = [], 0
            start = stop
    if held:
        yield _joined(held)
    give_back_memory()


def give_back_memory() -> None:
    """Return freed memory to the system: worker processes live on after their task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def freeing(function: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The function of a group, giving memory back after every group."""

    def run(group: pa.Table) -> pa.Table:
        result = function(group)
        give_back_memory()
        return result

    return run


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def texts_of(batch: pa.RecordBatch, text: str) -> list[str]:
    """The texts of a batch; a missing text is the empty text."""
    return pc.fill_null(batch.column(text).cast(pa.string()), "").to_pylist()


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every run, run after run."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: every input bit changes every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts."""
    return int(docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0)


# Up to this many bytes of text, blocks and buckets keep their sizes.
FAN_OUT_BYTES = 32 << 30


def fan_out(total: int, block: int, bucket: int) -> tuple[int, int, int]:
    """Bytes of a block, bytes of a bucket, and the number of buckets for ``total`` bytes.

    Every block may send a row to every bucket, so with fixed sizes the rows would grow with
    the square of the text. Beyond ``FAN_OUT_BYTES`` both sizes grow with the square root
    instead: rows then grow with the text, and at 1 TB a task holds six times as much.
    """
    factor = max(1.0, (total / FAN_OUT_BYTES) ** 0.5)
    block, bucket = int(block * factor), int(bucket * factor)
    return block, bucket, max(1, -(-total // bucket))


# A token after a text's last word; no word is a line feed.
END = np.uint64(xxhash.xxh3_64_intdigest(b"\n"))


def word_hashes(texts: pa.Array, end: np.uint64 | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's words, lower-cased for A-Z, and how many they are.

    White space is ASCII's. ``end`` is a token put after every text's words. A missing
    text counts as empty.
    """
    texts = pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), ""))
    lists = pc.ascii_split_whitespace(texts)
    words = pc.list_flatten(lists).dictionary_encode()
    hashes = np.fromiter(
        map(xxhash.xxh3_64_intdigest, words.dictionary.cast(pa.binary()).to_pylist()),
        dtype=np.uint64,
        count=len(words.dictionary),
    )
    parents = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    found = hashes[words.indices.to_numpy(zero_copy_only=False)]
    # Splitting leaves an empty word before leading and after trailing white space.
    filled = found != np.uint64(xxhash.xxh3_64_intdigest(b""))
    parents, found = parents[filled], found[filled]
    counts = np.bincount(parents, minlength=len(texts)).astype(np.int64)
    if end is None:
        return found, counts
    return np.insert(found, np.cumsum(counts), end), counts + 1
