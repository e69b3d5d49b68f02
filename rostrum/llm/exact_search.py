"""Exact top-k inner products over vectors sorted by length.

Vectors become whole numbers, are numbered from the longest to the shortest and cut into
blocks. An eigenbasis of their second moments (the right singular vectors of the table)
puts most of an inner product into the first few rotated parts. A task holds a block of
queries against a block of candidates and goes through these from the longest on:

* a query whose length times the longest candidate left cannot reach its k-th best score is
  done (Cauchy-Schwarz on whole vectors);
* of the others, a partial sum over the leading parts, plus the product of what the rest of
  both vectors measures (Cauchy-Schwarz on residuals), bounds each score from above;
* only pairs whose bound reaches the k-th best score are multiplied out, in whole numbers.

All queries meet the block of the longest vectors first. What that gives is where their
bounds start, and pairs of blocks that no query of the block can gain from are never made.
Queries and candidates meet in blocks of bounded size, whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rostrum.llm.common import freeing, table
from rostrum.llm.registry import query
from rostrum.operators.numbering import number_by_key
from rostrum.session import discard, materialize

NEIGHBOURS = 5
SCALE = 256
# Rows of a block of candidates and of a block of queries that meet in one task.
CANDIDATE_ROWS = 32_768
QUERY_ROWS = 4096
# Candidates that are compared at a time, and rotated parts of the partial sums.
STEP = 1024
LEADING = 16
# A whole number of this size or more makes a vector take no part: scores must fit a long.
LARGEST = 1 << 26

_PLACES = pa.schema(
    [("key", pa.int64()), ("asks", pa.bool_()), ("parts", pa.binary()), ("length", pa.float64())]
)


def _whole(vectors: DataFrame, dimension: int, scale: int) -> DataFrame:
    """``key, asks, parts, length``: whole numbers as bytes, shorter vectors padded with zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            lists = lists.cast(pa.list_(pa.float64()))
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
            there = lists.is_valid().to_numpy(zero_copy_only=False)
            sizes = np.where(there, sizes, 0)
            with np.errstate(over="ignore", invalid="ignore"):
                scaled = np.floor(scale * values)
                bad = ~(np.abs(scaled) < LARGEST)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            there[owner[bad]] = False
            parts = np.zeros((len(sizes), dimension), dtype="<i4")
            column = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            parts[owner, column] = np.where(bad, 0, scaled)
            length = np.sqrt(np.square(parts, dtype=np.float64).sum(axis=1))
            out = pa.RecordBatch.from_arrays(
                [
                    batch.column("key").cast(pa.int64()),
                    batch.column("asks"),
                    pa.array([row.tobytes() for row in parts], pa.binary()),
                    pa.array(length),
                ],
                schema=_PLACES,
            )
            yield out.filter(pa.array(there))

    return vectors.mapInArrow(run, "key long, asks boolean, parts binary, length double")


def _matrix(parts: pa.ChunkedArray | pa.Array, dimension: int) -> np.ndarray:
    joined = b"".join(parts.to_pylist())
    return np.frombuffer(joined, dtype="<i4").reshape(-1, dimension).astype(np.float64)


def _rotation(stored: DataFrame, dimension: int) -> np.ndarray:
    """Orthogonal matrix whose first columns carry most of the vectors' squares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimension, dimension))
        for batch in batches:
            own = _matrix(batch.column("parts"), dimension)
            total += own.T @ own
        cells = np.flatnonzero(total)
        yield pa.record_batch([pa.array(cells), pa.array(total.ravel()[cells])], ["cell", "value"])

    sums = stored.select("parts").mapInArrow(run, "cell long, value double")
    moments = np.zeros(dimension * dimension)
    # As many rows as the square of the dimension, whatever the table's size.
    for row in sums.groupBy("cell").agg(F.sum("value").alias("value")).collect():
        moments[row.cell] = row.value
    _, vectors = np.linalg.eigh(moments.reshape(dimension, dimension))
    return np.ascontiguousarray(vectors[:, ::-1])


class _Best:
    """The k best candidates of every query so far, and what a further one has to reach."""

    def __init__(self, k: int, reach: np.ndarray, reach_key: np.ndarray):
        self.k = k
        self.reach, self.reach_key = reach.copy(), reach_key.copy()
        self.rows = [np.empty(0, dtype=np.int64) for _ in range(4)]

    def add(self, query: np.ndarray, score: np.ndarray, key: np.ndarray, number: np.ndarray) -> None:
        better = (score > self.reach[query]) | ((score == self.reach[query]) & (key <= self.reach_key[query]))
        new = (query[better], score[better].astype(np.int64), key[better], number[better])
        if not len(new[0]):
            return
        rows = [np.concatenate(pair) for pair in zip(self.rows, new, strict=True)]
        order = np.lexsort((rows[3], rows[2], -rows[1], rows[0]))
        rows = [r[order] for r in rows]
        begins = np.flatnonzero(np.append(True, rows[0][1:] != rows[0][:-1]))
        rank = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
        last = rank == self.k - 1
        self.reach[rows[0][last]] = rows[1][last]
        self.reach_key[rows[0][last]] = rows[2][last]
        self.rows = [r[rank < self.k] for r in rows]


# A missing key comes last among equal scores.
_NO_KEY = np.iinfo(np.int64).max


def search_block(candidates: pa.Table, queries: pa.Table, rotation: np.ndarray, k: int) -> pa.Table:
    """``query`` (number), ``score``, ``key``, ``number`` of each query's best in a block."""
    dimension = len(rotation)
    candidates = candidates.sort_by("number")
    numbers, query_numbers = (t["number"].to_numpy() for t in (candidates, queries))
    keys = candidates["key"].fill_null(_NO_KEY).to_numpy()
    theirs, ours = _matrix(candidates["parts"], dimension), _matrix(queries["parts"], dimension)
    lengths, own = candidates["length"].to_numpy(), queries["length"].to_numpy()
    lead = rotation[:, : min(LEADING, dimension)]
    their_lead, our_lead = theirs @ lead, ours @ lead
    their_rest, our_rest = (
        np.sqrt(np.maximum(0.0, np.square(n) - np.square(x).sum(axis=1)))
        for n, x in ((lengths, their_lead), (own, our_lead))
    )
    # Sums that doubles may round are made of 64-bit whole numbers.
    if dimension * np.abs(theirs).max(initial=0) * np.abs(ours).max(initial=0) >= 2**53:
        theirs, ours = theirs.astype(np.int64), ours.astype(np.int64)
    reach = queries["reach"].fill_null(-np.inf).to_numpy()
    best = _Best(k, reach, queries["reach_key"].fill_null(_NO_KEY).to_numpy())
    for start in range(0, len(numbers), STEP):
        part = slice(start, start + STEP)
        # Doubles are off by far less than this.
        slack = 1e-6 + 1e-9 * own * lengths[start]
        live = np.flatnonzero(own * lengths[start] + slack >= best.reach)
        if not len(live):
            break
        bound = our_lead[live] @ their_lead[part].T
        bound += np.outer(our_rest[live], their_rest[part])
        hit = bound + slack[live, None] >= best.reach[live, None]
        if np.count_nonzero(hit) * 8 > hit.size:
            scores = ours[live] @ theirs[part].T
            hit &= scores >= best.reach[live, None]
            query, candidate = np.nonzero(hit)
            score = scores[query, candidate]
        else:
            query, candidate = np.nonzero(hit)
            score = np.concatenate(
                [np.empty(0, ours.dtype)]
                + [
                    np.einsum("ij,ij->i", ours[live[q]], theirs[start + c])
                    for q, c in zip(*(np.array_split(x, 1 + len(x) // 65536) for x in (query, candidate)), strict=True)
                ]
            )
        query, candidate = live[query], start + candidate
        other = numbers[candidate] != query_numbers[query]
        best.add(query[other], score[other], keys[candidate[other]], numbers[candidate[other]])
    query, score, key, number = best.rows
    return pa.table(
        {
            "query": pa.array(query_numbers[query]),
            "score": pa.array(score),
            "key": pa.array(key, mask=key == _NO_KEY),
            "number": pa.array(number),
        }
    )


def _meet(candidates: DataFrame, queries: DataFrame, pairs: DataFrame, rotation: np.ndarray, k: int) -> DataFrame:
    """Best candidates of every query in each of the pairs of blocks."""

    @freeing
    def both(group: tuple) -> pa.Table:
        return search_block(*group, rotation, k)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return both((left, right))

    on = ["block", "query_block"]
    left = candidates.join(pairs, "block").select(*on, "number", "key", "parts", "length").groupBy(*on)
    right = queries.join(pairs, "query_block").drop("key").groupBy(*on)
    return left.cogroup(right).applyInArrow(run, "query long, score long, key long, number long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("key"), "number")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_products(
    vectors: DataFrame,
    asks: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = NEIGHBOURS,
    scale: int = SCALE,
    candidate_rows: int = CANDIDATE_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` best, exactly.

    ``asks`` says which rows are queries; a missing answer is no. All rows but the query's
    own are its candidates, also rows of equal key or content; each row that asks gets its
    own ranks. Components become floor(``scale`` * x). Vectors that are missing, or hold a
    missing or non-finite component or one of 2^26 or more after that, take no part; shorter
    vectors count as padded with zeros, so an empty one scores 0 with all. Equal scores go
    to the smaller key, a missing key is the largest. Keys must be whole numbers; other
    columns are not read. An empty table, or one without a query, gives no rows.
    """
    rows = vectors.select(
        F.col(f"`{key}`").alias("key"),
        F.col(f"`{vector}`").alias("vector"),
        F.coalesce(asks, F.lit(False)).alias("asks"),
    )
    dimension = max(1, rows.agg(F.max(F.size("vector"))).first()[0] or 0)
    stored = materialize(_whole(rows, dimension, scale), "vectors")
    rotation = _rotation(stored, dimension)
    candidates = number_by_key(stored, [F.desc("length"), "key"], name="number")
    blocks = candidates.withColumn("block", F.floor(F.col("number") / candidate_rows))
    asking = number_by_key(blocks.filter("asks").drop("asks", "block"), ["number"], name="place")
    queries = asking.withColumn("query_block", F.floor(F.col("place") / query_rows)).drop("place")
    asked = queries.select(F.lit(0).cast("long").alias("block"), "query_block").distinct()
    opening = materialize(asked, "pairs")
    longest = materialize(blocks.groupBy("block").agg(F.max("length").alias("longest")), "blocks")

    open_queries = queries.withColumns({"reach": F.lit(None).cast("double"), "reach_key": F.lit(None).cast("long")})
    first = materialize(_meet(blocks, open_queries, opening, rotation, k), "first")
    reach = _ranked(first, k).filter(F.col("rank") == k).select(
        F.col("query").alias("number"),
        F.col("score").cast("double").alias("reach"),
        F.coalesce("key", F.lit(int(_NO_KEY))).alias("reach_key"),
    )
    bounded = materialize(queries.join(reach, "number", "left"), "queries")
    # The shortest candidate that some query of the block may still gain from.
    need = F.when(F.col("reach").isNull() | (F.col("reach") <= 0), 0.0).otherwise(
        F.col("reach") / F.nullif("length", F.lit(0.0))
    )
    least = bounded.groupBy("query_block").agg(F.min(F.coalesce(need, F.lit(0.0))).alias("need"))
    count = longest.count()
    rest = least.select("query_block", "need", F.explode(F.sequence(F.lit(1), F.lit(max(1, count - 1)))).alias("block"))
    rest = rest.join(longest, "block").filter("longest * 1.000001 >= need").select("block", "query_block")
    rest = materialize(rest.select(F.col("block").cast("long").alias("block"), "query_block"), "pairs")
    later = _meet(blocks.filter("block > 0"), bounded, rest, rotation, k)
    best = _ranked(first.union(later), k)
    named = queries.select(F.col("number").alias("query"), F.col("key").alias("query_id"))
    result = materialize(
        best.join(named, "query").select("query_id", "rank", F.col("key").alias("vec_id"), "score"), "found"
    )
    discard(stored, candidates, asking, opening, longest, first, bounded, rest)
    return result


_SQL = """
WITH whole AS (
  SELECT row_number() OVER () AS r, vec_id,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scores AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, c.r AS other,
    CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.r <> c.r WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, other) AS rank FROM scores
) WHERE rank <= 5
"""


@query("op12_exact_search", _SQL)
def op12_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all other vectors for every fiftieth."""
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
