"""Exact n-gram Jaccard join: near-duplicate documents by token-combination prefixes.

A document is the set of its word shingles (tokens). Tokens are ordered from rare to
frequent. Two sets as alike as asked for share at least two tokens among the first few of
each, its extended prefix: all but the required overlap, and two more. Rare tokens of the
prefix are indexed one by one, frequent ones as pairs, so that a bucket of the index is
small, or its members share two frequent tokens among their rarest. Tokens that a single
document has are nobody's and are dropped first, and with them all documents that have too
few others. What the index finds is verified by the exact overlap.

Equal sets become one class at once. Components are what is asked for, so links within a
component need no check. Most are found from a dozen min-hash bands per class: of its
bands' hubs, each class is compared with one per round, and links merge classes. The index
is then cut down to the buckets whose members are in several components. These get rounds
of hubs as well; at last all members of a bucket that are still apart are compared, where
sizes and bitmaps of the sets rule most pairs out within the join. No link between
components is lost, and nothing grows with the square of a group that hubs can merge.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from rostrum.llm.common import (
    HASH_BYTES,
    expand,
    fan_out,
    freeing,
    mix64,
    sliced,
    table,
    text_bytes,
    word_hashes,
)
from rostrum.llm.packed import bucket_edges, pack, pack_sorted, unpack, unpack_sorted
from rostrum.llm.registry import query
from rostrum.session import discard, materialize
from rostrum.sources.writers import stored_bytes

SHINGLE = 3
# Two sets are linked if the overlap is at least this many hundredths of the union.
PERCENT = 90
# A token of more documents than this is frequent and indexed in pairs.
RARE_DOCUMENTS = 256
# Text of a block of documents, and of the corpus per hash bucket.
BLOCK_BYTES = 6 << 20
BUCKET_BYTES = 12 << 20
# Bits of a token in the index and in overlaps; sizes of sets are counted with 64.
BITS = 48
# Hubs are tried in this many rounds at most before the rest is compared.
HUB_ROUNDS = 3
# Min-hash bands of a class, each of two hashes. Two sets with four fifths in common meet in
# one of them but for 5 cases in a million; the index finds those.
BANDS = 12
# The tokens of a prefix are paired within groups. A set has one group for this many tokens,
# so that the pairs of a prefix grow with its length, not with its square.
GROUP_TOKENS = 64
# Hubs whose stored tokens take no more than this are sent to all tasks; more are shuffled.
BROADCAST_BYTES = 32 << 20
# What is made of a table no larger than this, a row per key at most, is sent to all tasks.
# Of a larger one it is stored and shuffled: a store costs a file for each shuffle partition.
FEW_BYTES = 4 << 20
# The same, for rows of two numbers.
FEW_ROWS = 1 << 17
# Index entries that a task hands over at once.
ENTRIES_AT_ONCE = 1 << 16

# Bits of a set's bitmap, in longs of 64. A token flips one bit, so two sets differ in at
# least as many tokens as their bitmaps in bits.
BITMAP = 8
_MAPS = [f"map{i}" for i in range(BITMAP)]

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_BINARIES = pa.list_(pa.binary())


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Distinct shingle hashes of every text, ascending; fewer words are one shingle."""
    words, counts = word_hashes(texts)
    joined = words
    for k in range(1, size):
        joined = mix64(joined[:-1] * _FACTOR + words[k:] + np.uint64(k)) if len(joined) > 1 else joined[:0]
    sets, start = [], 0
    for n in counts.tolist():
        if n >= size:
            sets.append(np.unique(joined[start : start + n - size + 1]))
        elif n:
            whole = words[start : start + n].tobytes()
            sets.append(np.array([xxhash.xxh3_64_intdigest(whole, seed=n)], dtype=np.uint64))
        else:
            sets.append(words[:0])
        start += n
    return sets


def required(n: int, percent: int) -> int:
    """Least overlap of a set of n tokens with any set it is linked to."""
    return -(-percent * n // 100)


def _row_schema(key: pa.DataType) -> pa.Schema:
    return pa.schema(
        [
            ("block", pa.int64()),
            ("bucket", pa.int32()),
            ("tokens", pa.binary()),
            ("counts", pa.binary()),
            ("keys", pa.list_(key)),
            ("sizes", pa.binary()),
            ("digests", pa.list_(pa.binary())),
            ("places", pa.binary()),
        ]
    )


def _sets(docs: DataFrame, size: int, buckets: int, block_bytes: int) -> DataFrame:
    """Stored rows of two kinds: a block's tokens by bucket, and its documents (no bucket)."""
    kind = docs.schema["key"].dataType.simpleString()
    schema = (
        f"block long, bucket int, tokens binary, counts binary, keys array<{kind}>, "
        "sizes binary, digests array<binary>, places binary"
    )
    edges = bucket_edges(buckets, BITS)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
        keys, sets, taken = [], [], 0
        for batch in sliced(batches, "text", HASH_BYTES):
            sets += shingle_sets(batch.column("text"), size)
            keys.append(batch.column("key"))
            taken += batch.column("text").nbytes
            if taken >= block_bytes:
                yield keys, sets
                keys, sets, taken = [], [], 0
        if keys:
            yield keys, sets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, (key_parts, sets) in enumerate(blocks(batches)):
            block, keys = (part << 32) + number, pa.concat_arrays(key_parts)
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            short = np.concatenate(sets) >> np.uint64(64 - BITS)
            # The leading bits keep the order, so each document's places ascend.
            tokens, places, counts = np.unique(short, return_inverse=True, return_counts=True)
            offsets = np.cumsum(sizes) - sizes
            steps = np.diff(places, prepend=0)
            steps[offsets[sizes > 0]] = places[offsets[sizes > 0]]
            out = _row_schema(keys.type)
            ends = pa.array([0, len(keys)], pa.int32())
            full = {
                "block": pa.array([block]),
                "keys": pa.ListArray.from_arrays(ends, keys),
                "sizes": pa.array([pack(sizes)]),
                "digests": pa.array([digests], _BINARIES),
                "places": pa.array([pack(steps)]),
            }
            yield pa.record_batch([full.get(f.name, pa.nulls(1, f.type)) for f in out], schema=out)
            cuts = np.append(np.searchsorted(tokens, edges), len(tokens)).tolist()
            asked = [(b, a, z) for b, (a, z) in enumerate(zip(cuts, cuts[1:])) if a < z]
            full = {
                "block": [block] * len(asked),
                "bucket": [b for b, _, _ in asked],
                "tokens": [pack_sorted(tokens[a:z]) for _, a, z in asked],
                "counts": [pack(counts[a:z]) for _, a, z in asked],
            }
            yield pa.record_batch(
                [pa.array(full[f.name], f.type) if f.name in full else pa.nulls(len(asked), f.type) for f in out],
                schema=out,
            )

    return materialize(docs.mapInArrow(run, schema), "sets")


def _answers(sets: DataFrame) -> DataFrame:
    """For every block and bucket, which of its tokens other documents have, and how many."""

    @freeing
    def run(group: pa.Table) -> pa.Table:
        own = [unpack_sorted(t) for t in group["tokens"].to_pylist()]
        counts = np.concatenate([unpack(c) for c in group["counts"].to_pylist()])
        _, place = np.unique(np.concatenate(own), return_inverse=True)
        sums = np.bincount(place, weights=counts).astype(np.int64)
        shared, at = [], 0
        for tokens in own:
            of = sums[place[at : at + len(tokens)]]
            kept = np.flatnonzero(of > 1)
            shared.append(
                [
                    pack(np.array([len(tokens)])),
                    pack_sorted(kept.astype(np.uint64)),
                    pack_sorted(tokens[kept]),
                    pack(of[kept]),
                ]
            )
            at += len(tokens)
        return pa.table(
            {
                "block": group["block"].combine_chunks(),
                "bucket": group["bucket"].combine_chunks(),
                "shared": pa.array(shared, _BINARIES),
            }
        )

    asked = sets.filter("bucket IS NOT NULL").select("block", "bucket", "tokens", "counts")
    return asked.groupBy("bucket").applyInArrow(run, "block long, bucket int, shared array<binary>")


def _documents(sets: DataFrame, kind: str, percent: int, rare: int) -> DataFrame:
    """Stored ``id, key, n, digest, tokens, rare, odd``.

    Tokens, from rare to frequent, are there where links are possible; the first ``rare``
    of them are in at most that many documents; both are missing elsewhere. ``odd`` of the
    set's tokens are in less than half as many documents as its median token: what a copy
    changed, if it is one.
    """

    @freeing
    def run(group: pa.Table) -> pa.Table:
        own = group.filter(pc.is_null(group["bucket"]))
        replies = group.filter(pc.is_valid(group["bucket"])).sort_by("bucket")["shared"].to_pylist()
        sizes = unpack(own["sizes"][0].as_py()).astype(np.int64)
        steps = unpack(own["places"][0].as_py()).astype(np.int64)
        total = sum(int(unpack(r[0])[0]) for r in replies)
        tokens, counts = np.zeros(total, dtype=np.uint64), np.zeros(total, dtype=np.int64)
        before = 0
        for length, kept, found, of in replies:
            at = unpack_sorted(kept).astype(np.int64) + before
            tokens[at], counts[at] = unpack_sorted(found), unpack(of).astype(np.int64)
            before += int(unpack(length)[0])
        ends = np.cumsum(sizes)
        lists: list[bytes | None] = []
        rares: list[int | None] = []
        odds: list[int] = []
        for begin, end in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
            n = end - begin
            places = np.cumsum(steps[begin:end])
            # A token that nobody else has is not in the answers and counts 0.
            middle = np.partition(counts[places], n // 2)[n // 2] if n else 0
            odds.append(int(np.count_nonzero(2 * counts[places] < middle)))
            places = places[counts[places] > 1]
            if n and len(places) >= required(n, percent):
                order = np.lexsort((tokens[places], counts[places]))
                lists.append(tokens[places][order].tobytes())
                rares.append(int(np.count_nonzero(counts[places] <= rare)))
            else:
                lists.append(None)
                rares.append(None)
        return pa.table(
            {
                "key": pc.list_flatten(own["keys"]).combine_chunks(),
                "n": pa.array(sizes),
                "digest": pc.list_flatten(own["digests"]).combine_chunks(),
                "tokens": pa.array(lists, pa.binary()),
                "rare": pa.array(rares, pa.int64()),
                "odd": pa.array(odds, pa.int64()),
            }
        )

    rows = sets.filter("bucket IS NULL").select("block", "bucket", "keys", "sizes", "digests", "places")
    met = rows.unionByName(_answers(sets), allowMissingColumns=True)
    found = met.groupBy("block").applyInArrow(
        run, f"key {kind}, n long, digest binary, tokens binary, rare long, odd long"
    )
    return materialize(found.withColumn("id", F.monotonically_increasing_id()), "documents")


def _bitmap(tokens: np.ndarray) -> np.ndarray:
    bits = np.bincount((mix64(tokens) >> np.uint64(55)).astype(np.int64), minlength=64 * BITMAP) & 1
    return np.packbits(bits.astype(np.uint8)).view("<i8")


_BAND_FACTORS = mix64(np.arange(1, 2 * BANDS + 1, dtype=np.uint64)) | np.uint64(1)


def _bands(classes: DataFrame) -> DataFrame:
    """``signature, id, odd``: a class's min-hash bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.empty((batch.num_rows, BANDS), dtype=np.uint64)
            for i, tokens in enumerate(batch.column("tokens").to_pylist()):
                own = mix64(np.frombuffer(tokens, dtype="<u8"))
                least = np.array([(own * f).min() for f in _BAND_FACTORS]).reshape(BANDS, 2)
                found[i] = mix64(least[:, 0] * _FACTOR + least[:, 1])
            ids, odd = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), BANDS) for c in ("id", "odd"))
            yield pa.record_batch(
                [pa.array(found.ravel().view(np.int64)), pa.array(ids), pa.array(odd)], ["signature", "id", "odd"]
            )

    return classes.select("id", "odd", "tokens").mapInArrow(run, "signature long, id long, odd long")


def token_groups(n: int) -> int:
    """Groups in which the tokens of a set of ``n`` are paired: a power of two."""
    return 1 << max(0, (n // GROUP_TOKENS).bit_length() - 1)


def signatures(tokens: np.ndarray, n: int, rare: int, percent: int) -> np.ndarray:
    """Index entries of a set of ``n`` tokens, of which ``tokens`` are not its alone.

    Two linked sets share G + 1 tokens among the first n - required + G + 1 of each. One of
    these is rare, or two of them fall into the same of G groups. G depends on the size; a
    set of a size that may be linked with smaller ones of fewer groups has the entries of
    those groups, too.
    """
    most, least = token_groups(n), token_groups(required(n, percent))
    # Tokens that nobody else has come first in the order.
    free = n - required(n, percent) + 1 - (n - len(tokens))
    found = [mix64(tokens[: max(0, min(rare, free + most))] + np.uint64(1))]
    groups = least
    while groups <= most:
        frequent = tokens[rare : max(rare, free + groups)]
        group = mix64(frequent) & np.uint64(groups - 1)
        order = np.lexsort((frequent, group))
        frequent, group = frequent[order], group[order]
        size = np.bincount(group.astype(np.int64), minlength=groups)
        ends = np.cumsum(size)
        # Every token is paired with those after it in its group.
        later = np.repeat(ends, size) - np.arange(len(frequent)) - 1
        first = np.repeat(np.arange(len(frequent)), later)
        second = expand(np.arange(len(frequent)) + 1, later)
        salt = mix64(np.array([groups], dtype=np.uint64))
        found.append(mix64((mix64(frequent[first]) ^ salt) * _FACTOR + frequent[second]))
        groups *= 2
    return np.concatenate(found).view(np.int64)


def _index(classes: DataFrame, percent: int) -> DataFrame:
    """``signature, id, odd, component``: index entries of every class's extended prefix."""
    names = ["signature", "id", "odd", "component"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("id", "odd", "component", "n", "rare", "tokens"))
            parts: list[tuple] = []
            held = 0
            for i, odd, component, n, rare, tokens in zip(*columns, strict=True):
                entries = signatures(np.frombuffer(tokens, dtype="<u8"), n, rare, percent)
                parts.append((entries, *(np.full(len(entries), v) for v in (i, odd, component))))
                held += len(entries)
                if held >= ENTRIES_AT_ONCE:
                    yield pa.record_batch([pa.array(np.concatenate(p)) for p in zip(*parts)], names)
                    parts, held = [], 0
            if parts:
                yield pa.record_batch([pa.array(np.concatenate(p)) for p in zip(*parts)], names)

    return classes.select("id", "odd", "component", "n", "rare", "tokens").mapInArrow(
        run, "signature long, id long, odd long, component long"
    )


def _profiles(classes: DataFrame) -> DataFrame:
    """``id, n, own`` (tokens that no other document has) and the bitmap of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.frombuffer(t, dtype="<u8") for t in batch.column("tokens").to_pylist()]
            maps = np.array([_bitmap(t) for t in tokens], dtype=np.int64).reshape(len(tokens), BITMAP)
            n = batch.column("n").to_numpy(zero_copy_only=False)
            own = n - np.array([len(t) for t in tokens], dtype=np.int64)
            yield pa.record_batch(
                [batch.column("id"), batch.column("n"), pa.array(own), *(pa.array(maps[:, k]) for k in range(BITMAP))],
                names=["id", "n", "own", *_MAPS],
            )

    maps = ", ".join(f"{m} long" for m in _MAPS)
    return classes.select("id", "n", "tokens").mapInArrow(run, f"id long, n long, own long, {maps}")


def _may_link(percent: int, left: str, right: str) -> Column:
    """False only for pairs whose sizes and bitmaps rule a link out."""
    total = F.col(f"{left}.n") + F.col(f"{right}.n")
    differ = F.col(f"{left}.own") + F.col(f"{right}.own")
    for m in _MAPS:
        differ = differ + F.bit_count(F.col(f"{left}.{m}").bitwiseXOR(F.col(f"{right}.{m}")))
    fits = 100 * F.least(f"{left}.n", f"{right}.n") >= percent * F.greatest(f"{left}.n", f"{right}.n")
    return fits & ((100 + percent) * (total - differ) >= 2 * percent * total)


def _linked(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Stored pairs ``a, b`` whose exact overlap is large enough.

    Pairs, and the tokens of the classes they name second, are stored first: few are sent to
    the tasks that read the classes, and the classes' tokens are shuffled only for many.
    """
    pairs = materialize(pairs, "pairs")
    tokens = classes.select("id", "n", "tokens")
    second = tokens.join(pairs.select(F.col("b").alias("id")).distinct(), "id", "left_semi")
    second = materialize(second, "second")
    others = second.toDF("b", "n_b", "tokens_b")
    if stored_bytes(second.sparkSession, second.scratch_path) <= BROADCAST_BYTES:
        others = F.broadcast(others)
    both = pairs.join(tokens.toDF("a", "n_a", "tokens_a"), "a").join(others, "b")
    least, most = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("tokens_a", "tokens_b", "n_a", "n_b"))
            kept = []
            for x, y, n, m in zip(*columns, strict=True):
                merged = np.sort(np.concatenate((np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"))))
                overlap = int(np.count_nonzero(merged[1:] == merged[:-1]))
                kept.append(100 * overlap >= percent * (n + m - overlap))
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"])
            yield out.filter(pa.array(kept, pa.bool_()))

    fits = both.filter(100 * least >= percent * most)
    found = materialize(fits.mapInArrow(run, "a long, b long"), "links")
    discard(pairs, second)
    return found


def _few(stored: DataFrame) -> bool:
    return stored_bytes(stored.sparkSession, stored.scratch_path) <= FEW_BYTES


def _side(found: DataFrame, name: str, few: bool) -> DataFrame:
    """Rows to be joined by their key: to all tasks if few, else stored, so a hot key can be split."""
    return F.broadcast(found) if few else materialize(found, name)


def _discard(*sides: DataFrame) -> None:
    discard(*(s for s in sides if hasattr(s, "scratch_path")))


def components(links: DataFrame) -> DataFrame:
    """Stored ``id, component`` (the least id) for all that have a link, but the least.

    Large-star and small-star steps, each a minimum per node, until the links are one star
    per component: until no node has two smaller neighbours, or smaller and larger ones.
    Neither step makes more links than there were, so repeated ones can stay. ``links``
    are read in each step of the first round, so they should be stored.
    """
    edges, stored = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v"), []
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        found = both.groupBy("u").agg(
            F.min("v").alias("m"), F.max(F.when(F.col("v") < F.col("u"), F.col("v"))).alias("top"), F.max("v").alias("most")
        )
        seen = Observation()
        unsettled = F.count(F.when(F.expr("m < u AND (top > m OR most > u)"), 1)).alias("unsettled")
        found = found.observe(seen, unsettled, F.count("*").alias("nodes")).select("u", "m")
        least = materialize(found, "least")
        if not seen.get["unsettled"]:
            discard(*stored)
            return _stored_as(least.filter("m < u").toDF("id", "component"), least)
        few = seen.get["nodes"] <= FEW_ROWS
        near = least.select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = edges.join(F.broadcast(near) if few else near, "v").select("u", F.col("m").alias("v"))
        lower = _side(large.groupBy("u").agg(F.min("v").alias("m")), "lower", few)
        # A link to a node's least smaller neighbour stays, others lead from it to the least.
        met = large.join(lower, "u")
        small = met.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialize(small.union(lower.toDF("u", "v")), "edges")
        _discard(least, lower, *stored)
        edges, stored = new, [new]


def _stored_as(found: DataFrame, stored: DataFrame) -> DataFrame:
    """What is read of a stored table, which can still be discarded."""
    found.scratch_path = stored.scratch_path
    return found


def _with_component(table: DataFrame, stars: DataFrame | None) -> DataFrame:
    """The table with the component of its ``id``; without a link, this is the id."""
    plain = table.drop("component")
    if stars is None:
        return plain.withColumn("component", F.col("id"))
    return plain.join(stars, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _merged(
    entries: DataFrame, classes: DataFrame, stars: DataFrame | None, percent: int, rounds: int
) -> DataFrame | None:
    """Components after rounds in which each class is compared with one of its buckets' hubs.

    A bucket's hub is the member with the fewest odd tokens, in another order of equals in
    each round: of a group of copies, the one nearest to what they are copies of, which
    most of them are linked to. A class takes the hub it shares most buckets with in the
    first round and any of its hubs in later ones; hubs in its own component don't count.
    """
    few = _few(entries)
    for number in range(rounds):
        named = _with_component(entries, stars)
        rank = F.struct("odd", F.xxhash64("id", F.lit(number)).alias("rank"), "id", "component")
        hubs = named.groupBy("signature").agg(F.min(rank).alias("hub"))
        hubs = hubs.select("signature", F.col("hub.id").alias("b"), F.col("hub.component").alias("of"))
        hubs = _side(hubs, "hubs", few)
        met = named.join(hubs, "signature").filter("component != of")
        met = met.select(F.col("id").alias("a"), "b")
        order = F.xxhash64("a", "b", F.lit(number)).alias("order")
        if number:
            shared, best = met, F.struct(order, "b")
        else:
            shared, best = met.groupBy("a", "b").agg(F.count("*").alias("shared")), F.struct("shared", order, "b")
        pairs = shared.groupBy("a").agg(F.max(best).alias("best")).select("a", F.col("best.b").alias("b"))
        new = _linked(pairs, classes, percent)
        _discard(hubs)
        if new.isEmpty():
            discard(new)
            break
        before = stars
        if before is not None:
            star = before.select(F.col("id").alias("a"), F.col("component").alias("b"))
            stars = components(new.union(star))
            discard(before, new)
        else:
            stars = components(new)
            discard(new)
    return stars


def _apart(entries: DataFrame, few: bool) -> DataFrame:
    """Stored entries of the buckets whose members are in several components."""
    ends = entries.groupBy("signature").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = _side(ends.filter("low != high").select("signature"), "mixed", few)
    found = materialize(entries.join(mixed, "signature", "left_semi"), "apart")
    _discard(mixed)
    return found


def _pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs ``a, b`` of a bucket that are apart and may be linked."""
    met = entries.alias("l").join(
        entries.alias("r"),
        (F.col("l.signature") == F.col("r.signature"))
        & (F.col("l.id") < F.col("r.id"))
        & (F.col("l.component") != F.col("r.component"))
        & _may_link(percent, "l", "r"),
    )
    return met.select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    size: int = SHINGLE,
    percent: int = PERCENT,
    rare: int = RARE_DOCUMENTS,
    hub_rounds: int = HUB_ROUNDS,
    block_bytes: int = BLOCK_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Key, ``n_shingles`` and ``component_id`` (the least key reachable) of every row.

    A text of fewer words than ``size`` is one shingle; a text without words, or missing,
    has none and is linked with nothing. Rows with equal texts are linked, whatever their
    keys; a row with a missing key takes part, and a component of such rows alone has a
    missing id. Other columns are not read. An empty table gives no rows. ``percent`` must
    be above 50.
    """
    if percent <= 50:
        raise ValueError("sets that share one token only may be linked at 50 % or less")
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    block_bytes, bucket_bytes, buckets = fan_out(text_bytes(docs, text), block_bytes, bucket_bytes)
    kind = rows.schema["key"].dataType.simpleString()
    sets = _sets(rows, size, buckets, block_bytes)
    stored = _documents(sets, kind, percent, rare)
    discard(sets)
    found = materialize(stored.select("key", "n", "digest"), "keys")
    filled = stored.filter("n > 0").groupBy("digest")
    least = F.min("id").alias("id"), F.min("key").alias("least"), F.max("rare").alias("rare")
    named = materialize(filled.agg(*least), "named")
    # Equal sets all have tokens, and a number of rare ones, or none. Few sets do, so their
    # ids are fewer than all ids: stored apart, they are small enough for the tokens to stay.
    likely = stored.filter("tokens IS NOT NULL").select("id", "n", "tokens", "rare", "odd")
    firsts = materialize(named.filter("rare IS NOT NULL").select("id"), "firsts")
    classes = materialize(likely.join(firsts, "id", "left_semi"), "classes")
    discard(stored, firsts)
    bands = materialize(_bands(classes), "bands")
    stars = _merged(bands, classes, None, percent, hub_rounds)
    discard(bands)
    index = materialize(_index(_with_component(classes, stars), percent), "index")
    apart = _apart(index, _few(index))
    discard(index)
    if not apart.isEmpty():
        stars = _merged(apart, classes, stars, percent, hub_rounds)
        rest = _apart(_with_component(apart, stars), _few(apart))
        wide = materialize(rest.join(_profiles(classes), "id"), "wide")
        new = _linked(_pairs(wide, percent), classes, percent)
        if not new.isEmpty():
            old = [] if stars is None else [stars.select(F.col("id").alias("a"), F.col("component").alias("b"))]
            stars = components(reduce(DataFrame.union, old, new))
        discard(rest, wide, new)
    discard(apart, classes)
    # Both sides of these joins are stored unless few, so that a hot component or text can be split.
    members = materialize(_with_component(named, stars).select("digest", "component", "least"), "members")
    tops = _side(members.groupBy("component").agg(F.min("least").alias("top")), "tops", _few(members))
    answer = materialize(members.join(tops, "component").select("digest", "top"), "answer")
    discard(named, members)
    _discard(tops)
    linked = found.filter("n > 0").join(answer, "digest").select("key", "n", "top")
    alone = found.filter("n = 0").select("key", "n", F.col("key").alias("top"))
    return linked.union(alone).select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("top").alias("component_id")
    )


def _placed(docs: DataFrame) -> DataFrame:
    """Numbered columns, and the place of each row in the files that it is read from."""
    place = docs.metadataColumn("_metadata")
    return docs.select(
        *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)),
        F.xxhash64(place["file_path"]).alias("file"),
        place["row_index"].alias("place"),
    )


def drop_near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """One row of each component, the one with the least key; all columns as they were.

    Rows without words all stay. Of rows with equal keys in a component one stays, always
    the same; a missing key is the least. Rows are told apart by file and position in it,
    which hold however the files are split among tasks; ``docs`` that are not rows of Parquet
    files as they were read are stored first.
    """
    try:
        plain = _placed(docs)
    except AnalysisException:
        plain = _placed(materialize(docs, "rows"))
    name, content = (f"c{docs.columns.index(c)}" for c in (key, text))
    ranked = plain.select(F.struct(F.col(name).alias("key"), "file", "place").alias("rank"), content)
    found = near_duplicates(ranked, "rank", content, size, percent)
    stay = found.filter("n_shingles = 0 OR component_id <=> rank").select("rank.file", "rank.place")
    return plain.join(stay, ["file", "place"], "left_semi").drop("file", "place").toDF(*docs.columns)


_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
  FROM words, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS t(i) WHERE len(w) > 0
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * o >= 90 * (x.n + y.n - o)
),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a
)
SELECT documents.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(reach.b) AS component_id
FROM documents JOIN reach ON reach.a = documents.doc_id
LEFT JOIN sizes ON sizes.doc_id = documents.doc_id GROUP BY documents.doc_id
"""


@query("op10_jaccard_join", _SQL)
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle set size and near-duplicate component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
