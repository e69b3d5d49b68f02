"""Order MinHash fingerprints: likeness that feels the order of a text's parts.

Every k-mer occurrence (the k-mer and how often it came before) has one 64-bit hash. Its
leading bits say which component it belongs to; of each component the smallest few
occurrences are taken, put back into the order they have in the text, and hashed as a
tuple. Texts agree in a component if they share its occurrences in the same order, so
moved or replaced passages lower the share of equal components, as edit distance does.
Splitting one hash over the components instead of hashing everything once per component
makes a text cost two sorts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rostrum.llm.common import mix64, sliced, table
from rostrum.llm.registry import query

# Code points of a k-mer, components of a fingerprint, occurrences per component.
KMER = 8
COMPONENTS = 64
PICKED = 2
# Text of one range of documents, and most ranges a table is cut into. Ranges are
# streamed, so a larger one costs no memory.
RANGE_BYTES = 4 << 20
MAX_RANGES = 4096

_POSITION = np.uint64((1 << 24) - 1)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _kmer_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k code points from every position; shorter texts are one k-mer."""
    k, width = min(k, len(codes)), 1
    hashes = mix64(codes.astype(np.uint64) + np.uint64(1))
    while width < k:
        step = min(width, k - width)
        hashes = hashes[:-step] * _FACTOR + (hashes[step:] ^ (hashes[step:] >> np.uint64(29)))
        width += step
    return mix64(hashes)


def _sorted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leading 40 bits in order, and the positions they come from, ascending among equals."""
    if len(hashes) <= int(_POSITION):
        packed = (hashes & ~_POSITION) | np.arange(len(hashes), dtype=np.uint64)
        packed.sort()
        return packed >> np.uint64(24), (packed & _POSITION).astype(np.int64)
    leading = hashes >> np.uint64(24)
    order = np.argsort(leading, kind="stable")
    return leading[order], order


def fingerprint(
    text: str, k: int = KMER, components: int = COMPONENTS, picked: int = PICKED
) -> np.ndarray:
    """One 32-bit number per component (a power of two of them), 0 where nothing fell."""
    parts = np.zeros(components, dtype=np.uint32)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if not len(codes):
        return parts
    kmers, positions = _sorted(_kmer_hashes(codes, k))
    rank = np.arange(len(kmers))
    first = np.append(True, kmers[1:] != kmers[:-1])
    number = rank - np.maximum.accumulate(np.where(first, rank, 0))
    numbered = np.empty(len(kmers), dtype=np.uint64)
    numbered[positions] = mix64(kmers * _FACTOR + number.astype(np.uint64))
    smallest, places = _sorted(numbered)
    shift = np.uint64(40 - (components.bit_length() - 1))
    begin = np.searchsorted(smallest >> shift, np.arange(components + 1, dtype=np.uint64))
    take = begin[:-1, None] + np.arange(picked)
    there = take < begin[1:, None]
    take = np.minimum(take, len(smallest) - 1)
    place = np.where(there, places[take], np.iinfo(np.int64).max)
    values = np.where(there, smallest[take], np.uint64(0))
    values = np.take_along_axis(values, np.argsort(place, axis=1, kind="stable"), axis=1)
    hashed = np.zeros(components, dtype=np.uint64)
    for j in range(picked):
        hashed = mix64(hashed * _FACTOR + values[:, j] + np.uint64(j + 1))
    filled = there[:, 0]
    parts[filled] = np.maximum((hashed[filled] >> np.uint64(32)).astype(np.uint32), 1)
    return parts


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """Share of equal components among those that either text fills; 1 for two empty texts."""
    filled = (one > 0) | (other > 0)
    return float(np.mean(one[filled] == other[filled])) if filled.any() else 1.0


def fingerprints(docs: DataFrame, text: str = "text", column: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint as hexadecimal text; all rows and columns stay.

    A missing text counts as empty. A column of that name is replaced.
    """
    docs = docs.drop(column)
    schema = docs.withColumn(column, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            prints = [fingerprint(t or "").tobytes().hex() for t in texts]
            yield pa.record_batch([*batch.columns, pa.array(prints)], names=[*batch.schema.names, column])

    return docs.mapInArrow(run, schema)


def _search(bounds: list[int], key: Column) -> Column:
    """How many of the ascending bounds are not above the key, in two short steps."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.array(*[F.lit(p[0]) for p in parts])
    nested = F.array(*[F.array(*[F.lit(v) for v in p]) for p in parts])
    block = F.size(F.filter(heads, lambda b: b <= key))
    within = F.size(F.filter(F.try_element_at(nested, block), lambda b: b <= key))
    return F.when(block > 0, (block - 1) * step + within).otherwise(0)


def with_next_in_order(docs: DataFrame) -> DataFrame:
    """Rows ``key, text`` dealt out in ranges of ascending key, in order within each.

    Added: ``range`` and ``ahead``. The rows with ``ahead`` = 1 at the end of a range are
    copies of the rows that follow it: the first key of the next range, and of the first
    range after the last. Texts are shuffled once; besides, the driver has two numbers per
    range, of which there are at most ``MAX_RANGES``. Missing keys come first, rows with
    equal keys are ordered by text.
    """
    key = F.coalesce("key", F.lit(-(1 << 63)))
    rows = docs.select(key.alias("order_key"), "key", F.coalesce("text", F.lit("")).alias("text"))
    cuts = [i / MAX_RANGES for i in range(1, MAX_RANGES)]
    found = rows.agg(
        F.sum(F.octet_length("text")).alias("size"),
        F.percentile_approx("order_key", cuts, 100 * MAX_RANGES).alias("cuts"),
    ).first()
    ranges = min(MAX_RANGES, max(1, (found["size"] or 0) // RANGE_BYTES))
    step = MAX_RANGES / ranges
    bounds = sorted({found["cuts"][round(i * step) - 1] for i in range(1, ranges)} if found["cuts"] else ())
    ranged = rows.withColumn("range", _search(bounds, F.col("order_key")))
    first = {
        r["range"]: r["first"]
        for r in ranged.groupBy("range").agg(F.min("order_key").alias("first")).collect()
    }
    full = sorted(first)
    before = {at: full[i - 1] for i, at in enumerate(full)}
    if not full:
        return ranged.withColumn("ahead", F.lit(0))
    starts = F.create_map(*[F.lit(v) for at in full for v in (at, first[at])])
    previous = F.create_map(*[F.lit(v) for at in full for v in (at, before[at])])
    own = F.struct(F.col("range"), F.lit(0).alias("ahead"))
    copy = F.struct(previous[F.col("range")].alias("range"), F.lit(1).alias("ahead"))
    goes = F.when(F.col("order_key") == starts[F.col("range")], F.array(own, copy)).otherwise(F.array(own))
    dealt = ranged.withColumn("at", F.explode(goes)).select("order_key", "key", "text", "at.*")
    return dealt.repartition("range").sortWithinPartitions("range", "ahead", "order_key", "text")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
    """Each row's key and text with the text that follows."""
    open_range, waiting = None, None
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("range", "ahead", "key", "text"))
        for at, ahead, key, text in zip(*columns, strict=True):
            if waiting is not None and at == open_range:
                yield (*waiting, text)
            open_range, waiting = at, None if ahead else (key, text)


def edited_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of the text with its last quarter replaced.

    The last floor(n / 4) code points give way to as many (or all) first ones of the next
    document in ascending order of the integer key; after the last comes the first.
    Columns: the key, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``. A missing text counts as
    empty; a missing key comes first; rows with equal keys follow each other in order of
    text. A single row is followed by itself. Other columns are not read.
    """
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, known = [], None
        for key, text, after in _pairs(sliced(batches, "text")):
            cut = len(text) // 4
            edited = text[: len(text) - cut] + after[:cut]
            own = known[1] if known is not None and known[0] is text else fingerprint(text)
            other, following = fingerprint(edited), fingerprint(after)
            known = (after, following)
            rows.append(
                (
                    key,
                    len(text),
                    hashlib.sha256(edited.encode()).hexdigest(),
                    own.tobytes().hex(),
                    other.tobytes().hex(),
                    likeness(own, other),
                    likeness(own, following),
                )
            )
            if len(rows) == 1000:
                yield _as_batch(rows)
                rows = []
        yield _as_batch(rows)

    found = with_next_in_order(rows).select("range", "ahead", "key", "text").mapInArrow(
        run,
        "key long, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double",
    )
    return found.withColumnRenamed("key", key)


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2)
    names = (
        "key n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next".split()
    )
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.record_batch([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=names)


@query("op5_order_minhash")
def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return edited_pairs(table(spark, sf_dir, "documents"))
