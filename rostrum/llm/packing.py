"""First-fit decreasing packing of token runs into sequences of fixed length.

Each document's ids are cut at multiples of the capacity; the remainders are packed.
Documents fall into random groups of bounded expected size, and every group is packed on
its own: pieces from long to short, each into the first open sequence with room, which a
tournament tree over the sequences' free room finds in logarithmic time. Only piece
lengths and checksums are shuffled, never ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rostrum.llm.common import sliced, table
from rostrum.llm.registry import query
from rostrum.llm.tokens import ENCODE_BYTES, encoder, vocabulary_path

CAPACITY = 4096
# Documents in a random group, on average.
GROUP_DOCUMENTS = 4000

PIECES = "key {kind}, start long, length long, ids_crc32 long, doc_tokens long, grp long"
PACKED = (
    "key {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)


class FirstFit:
    """Open bins in a tournament tree: each node knows the most free room below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)
        self.capacity = capacity

    def place(self, size: int) -> tuple[int, int]:
        """Put an item into the first bin with room; its bin and offset there."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        found, offset = node - self.leaves, self.capacity - room[node]
        room[node] -= size
        node >>= 1
        while node:
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
            node >>= 1
        return found, offset


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item; no item may be larger than the capacity.

    Ties keep the order of the items. There can never be more bins than items.
    """
    bins = np.empty(len(sizes), dtype=np.int64)
    offsets = np.empty(len(sizes), dtype=np.int64)
    if not len(sizes):
        return bins, offsets
    # Items above half the capacity open a bin each, any two others share at worst.
    tree = FirstFit(len(sizes), capacity)
    for i in np.argsort(-sizes, kind="stable").tolist():
        bins[i], offsets[i] = tree.place(int(sizes[i]))
    return bins, offsets


def token_pieces(
    docs: DataFrame,
    vocabulary: str,
    groups: int,
    end_id: int | None = 2,
    capacity: int = CAPACITY,
    key: str = "doc_id",
    text: str = "text",
    seed: int = 42,
    words: bool = True,
) -> DataFrame:
    """Cut every document's ids into pieces of at most ``capacity``, with a random group."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", ENCODE_BYTES):
            ids, ends = encoder(vocabulary, words).encode(batch.column("text"), end_id)
            counts = np.diff(ends, prepend=0)
            pieces = -(-counts // capacity)
            row = np.repeat(np.arange(len(ends)), pieces)
            number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = number * capacity
            length = np.minimum(counts[row] - start, capacity)
            first = (ends - counts)[row] + start
            raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8)
            bounds = zip((4 * first).tolist(), (4 * (first + length)).tolist(), strict=True)
            yield pa.record_batch(
                {
                    "key": batch.column("key").take(pa.array(row)),
                    "start": pa.array(start),
                    "length": pa.array(length),
                    "ids_crc32": pa.array([zlib.crc32(raw[a:b]) for a, b in bounds], pa.int64()),
                    "doc_tokens": pa.array(counts[row]),
                    "grp": batch.column("grp").take(pa.array(row)),
                }
            )

    # The place of reading, not the key, is hashed: copies of a row spread over groups.
    place = F.xxhash64(F.monotonically_increasing_id(), F.lit(seed))
    rows = docs.select(
        F.col(f"`{key}`").alias("key"),
        F.col(f"`{text}`").alias("text"),
        F.pmod(place, F.lit(groups)).alias("grp"),
    )
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(cut, PIECES.format(kind=kind))


def pack(
    docs: DataFrame,
    vocabulary: str,
    end_id: int | None = 2,
    capacity: int = CAPACITY,
    key: str = "doc_id",
    text: str = "text",
    group_documents: int = GROUP_DOCUMENTS,
    seed: int = 42,
    words: bool = True,
) -> DataFrame:
    """Sequence and offset of every piece of every document.

    Columns: the key, ``start`` (ids of the document before the piece), ``length``,
    ``ids_crc32`` (of the piece's ids), ``doc_tokens``, ``sequence_id`` and ``offset``.
    A missing or empty text has its end id alone, or no piece if there is none; rows
    with a missing or repeated key are packed like others, piece by piece. Other columns
    of ``docs`` are not read. An empty table gives no rows.
    """
    groups = max(1, -(-docs.count() // group_documents))
    pieces = token_pieces(docs, vocabulary, groups, end_id, capacity, key, text, seed, words)

    def fit(group: pa.Table) -> pa.Table:
        names = ["length", "key", "start", "ids_crc32"]
        group = group.sort_by([(name, "ascending") for name in names])
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), capacity)
        sequence = (group["grp"].to_numpy() << 32) + bins
        packed = group.drop_columns("grp").append_column("sequence_id", pa.array(sequence))
        return packed.append_column("offset", pa.array(offsets))

    kind = pieces.schema["key"].dataType.simpleString()
    packed = pieces.groupBy("grp").applyInArrow(fit, PACKED.format(kind=kind))
    return packed.withColumnRenamed("key", key)


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 ids."""
    return pack(table(spark, sf_dir, "documents"), vocabulary_path())
