"""Prefix trie of conversations from sorted neighbours, without a stack.

Conversations are sequences of turns. Sorted, those that share a prefix lie side by side, and
the prefix's members are the largest interval in which neighbours share at least that much.
A sparse table of minima over the neighbours' common lengths answers, for every candidate
prefix by itself, how far its interval reaches to the left and to the right: a binary search
over powers of two, all candidates at once.

A prefix is named by the exclusive or of a 128-bit hash of each turn and its position. These
names can be put together from parts, which keeps everything bounded:

* turns are numbered over range partitions, so one conversation may fill any number of them;
* a conversation is a row per ``BAND`` turns, and rows of a band are sorted by the prefix
  before the band, then by its turns;
* a task reads its sorted rows in chunks. Intervals end at a chunk's borders, and what a
  prefix has in several chunks is added up by its name: one row per chunk, not per member.

Sums over subtrees need no walk. Let a prefix's first member be the one with the least id.
All prefixes below it, and below each other member the new ones, are told by one number for
each conversation: how many code points it shares with a conversation of a smaller id. The
same intervals then add up these numbers, and the leaves, over their members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rostrum.llm.common import expand, table
from rostrum.llm.registry import query
from rostrum.operators.numbering import number_by_key
from rostrum.session import discard, materialize

# Turns of a row.
BAND = 512
# Turns that a task sorts out at a time.
CHUNK_TURNS = 1 << 17
# The query rebuilds each conversation from the first of this many.
GROUP = 100
# Fewer shared turns than this.
SHARED_TURNS = 6


def _turn_rows(turns: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """Stored ``conv, place`` (0, 1, ... in a conversation), two hashes of the turn, ``chars``."""
    plain = turns.select(
        F.col(f"`{key}`").cast("long").alias("conv"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    ).filter("conv IS NOT NULL")
    numbered = number_by_key(plain, ["conv", "turn", "role", "text"], name="row")
    narrow = materialize(
        numbered.select(
            "row",
            "conv",
            F.xxhash64("role", "text").alias("turn1"),
            F.xxhash64(F.lit(1), "role", "text").alias("turn2"),
            F.length("text").cast("long").alias("chars"),
        ),
        "turns",
    )
    discard(numbered)
    first = materialize(narrow.groupBy("conv").agg(F.min("row").alias("first")), "first")
    found = materialize(
        narrow.join(first, "conv").select("conv", (F.col("row") - F.col("first")).alias("place"), "turn1", "turn2", "chars"),
        "turns",
    )
    discard(narrow, first)
    return found


def rebuild(rows: DataFrame, group: int = GROUP, shared: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns, and the stored conversations.

    A conversation takes the first turns of the one its group is named after, and its own
    after as many. ``shared`` tells how many these are.
    """
    if shared is None:
        shared = F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED_TURNS
    sizes = rows.groupBy("conv").agg(F.count("*").alias("n"))
    convs = sizes.select("conv", (F.col("conv") - F.col("conv") % group).alias("base"), shared.alias("shared"))
    bases = sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left")
    convs = materialize(
        convs.withColumn("taken", F.least("shared", F.coalesce("base_n", F.lit(0)))).drop("base_n"), "convs"
    )
    own = rows.join(convs, "conv").filter("place >= shared")
    own = own.select("conv", (F.col("place") - F.col("shared") + F.col("taken")).alias("place"), "turn1", "turn2", "chars")
    heads = rows.filter(F.col("place") < SHARED_TURNS).withColumnRenamed("conv", "base")
    taken = convs.filter("taken > 0").join(heads, "base").filter("place < taken")
    return own.union(taken.select(*own.columns)), convs


def _banded(rebuilt: DataFrame, convs: DataFrame, band: int) -> DataFrame:
    """Stored rows of up to ``band`` turns each; band 0 starts with the root, at place -1."""
    hashed = rebuilt.select(
        "conv",
        "place",
        F.xxhash64("place", "turn1", "turn2").alias("hash1"),
        F.xxhash64(F.lit(1), "place", "turn1", "turn2").alias("hash2"),
        "chars",
    )
    zero = F.lit(0).cast("long")
    roots = convs.select("conv", F.lit(-1).cast("long"), zero, zero, zero)
    number = F.floor(F.greatest("place", F.lit(0)) / band).alias("band")
    turns = F.sort_array(F.collect_list(F.struct("place", "hash1", "hash2", "chars"))).alias("turns")
    rows = hashed.union(roots).groupBy("conv", number).agg(
        turns,
        F.bit_xor("hash1").alias("xor1"),
        F.bit_xor("hash2").alias("xor2"),
        F.sum("chars").alias("chars"),
    )
    before = Window.partitionBy("conv").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    starts = [
        F.coalesce(f(c).over(before), F.lit(0)).alias(name)
        for f, c, name in ((F.bit_xor, "xor1", "start1"), (F.bit_xor, "xor2", "start2"), (F.sum, "chars", "before"))
    ]
    return materialize(
        rows.select(
            "conv",
            "band",
            *starts,
            *(F.col(f"turns.{c}").alias(f"{c}s") for c in ("place", "hash1", "hash2")),
            F.col("turns.chars").alias("sizes"),
            *("xor1", "xor2", "chars"),
        ),
        "bands",
    )


class _Minima:
    """Sparse table: minima of all runs whose length is a power of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def right(self, at: np.ndarray, need: np.ndarray) -> np.ndarray:
        """The farthest place right of ``at`` up to which all values after it are ``need`` or more."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            fits = at + 1 < len(level)
            fits[fits] = level[at[fits] + 1] >= need[fits]
            at[fits] += 1 << k
        return at

    def left(self, at: np.ndarray, need: np.ndarray) -> np.ndarray:
        """The farthest place left of ``at`` after which all values up to it are ``need`` or more."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            start = at - (1 << k) + 1
            fits = start >= 0
            fits[fits] = self.levels[k][start[fits]] >= need[fits]
            at[fits] -= 1 << k
        return at

    def least(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Least value of places ``left`` to ``right``."""
        found = np.empty(len(left), dtype=self.levels[0].dtype)
        power = np.frexp((right - left + 1).astype(np.float64))[1] - 1
        for k in np.unique(power):
            own = power == k
            level = self.levels[k]
            found[own] = np.minimum(level[left[own]], level[right[own] - (1 << int(k)) + 1])
        return found


def intervals(sizes: np.ndarray, name1: np.ndarray, name2: np.ndarray, first: np.ndarray):
    """Candidate prefixes of sorted sequences: entry, and first and last sequence.

    ``name1`` and ``name2`` name the prefixes of all sequences, one after another; ``first``
    is the first entry of each that counts. Every distinct prefix is a candidate once, where
    it comes first.
    """
    count = len(sizes)
    begins = np.cumsum(sizes) - sizes
    shorter = np.minimum(sizes[:-1], sizes[1:])
    here, there = expand(begins[:-1], shorter), expand(begins[1:], shorter)
    same = (name1[here] == name1[there]) & (name2[here] == name2[there])
    # Equal prefixes have equal parts: entries are equal up to the first that is not.
    total = np.append(0, np.cumsum(same))
    ends = np.cumsum(shorter)
    common = np.append(0, total[ends] - total[ends - shorter]).astype(np.int64)
    start = np.maximum(common, first)
    length = np.maximum(0, sizes - start)
    sequence = np.repeat(np.arange(count), length)
    entry = expand(start, length)
    minima = _Minima(common)
    need = entry + 1
    return begins[sequence] + entry, minima.left(sequence, need), minima.right(sequence, need)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, turns = [], 0
    for batch in batches:
        sizes = np.diff(batch.column("places").offsets.to_numpy())
        start = 0
        for at, total in enumerate(np.cumsum(sizes).tolist()):
            if turns + total >= CHUNK_TURNS:
                yield pa.Table.from_batches([*held, batch.slice(start, at + 1 - start)])
                held, turns, start = [], -total, at + 1
        held.append(batch.slice(start))
        turns += int(sizes.sum())
    if any(len(b) for b in held):
        yield pa.Table.from_batches(held)


def _names(chunk: pa.Table, part: str, sizes: np.ndarray) -> np.ndarray:
    """Names of all prefixes of the rows, one after another."""
    hashes = chunk[f"hash{part}s"].combine_chunks().flatten().to_numpy()
    running = np.bitwise_xor.accumulate(hashes) if len(hashes) else hashes
    ends = np.cumsum(sizes)
    before = np.append(0, running)[ends - sizes]
    return running ^ np.repeat(before ^ chunk[f"start{part}"].to_numpy(), sizes)


def _partial(chunk: pa.Table, sums: bool) -> pa.RecordBatch:
    """What the rows of a chunk say about each prefix."""
    sizes = np.diff(chunk["places"].combine_chunks().offsets.to_numpy()).astype(np.int64)
    band, conv = chunk["band"].to_numpy(), chunk["conv"].to_numpy()
    own1, own2 = _names(chunk, "1", sizes), _names(chunk, "2", sizes)
    # Rows of later bands start with the prefix before them, which is told in the band before.
    later = (band > 0).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    name1, name2 = (
        np.insert(own, starts[band > 0], chunk[f"start{k}"].to_numpy()[band > 0]) for k, own in ((1, own1), (2, own2))
    )
    size = chunk["sizes"].combine_chunks().flatten().to_numpy()
    place = chunk["places"].combine_chunks().flatten().to_numpy()
    running = np.append(0, np.cumsum(size))
    path = running[:-1] - np.repeat(running[starts] - chunk["before"].to_numpy(), sizes)
    at, left, right = intervals(sizes + later, name1, name2, later)
    sequence = np.repeat(np.arange(len(sizes)), sizes + later)[at]
    # Entries of the rows as they are, without those put in.
    own = at - np.cumsum(later)[sequence]
    order = np.argsort(conv, kind="stable")
    rank = np.empty(len(conv), dtype=np.int64)
    rank[order] = np.arange(len(conv))
    least = order[_Minima(rank).least(left, right)]
    columns = {"name1": name1[at], "name2": name2[at], "conv": conv[least]}
    if sums:
        for name in ("shared", "leaf"):
            total = np.append(0, np.cumsum(chunk[name].to_numpy()))
            columns[name] = total[right + 1] - total[left]
        columns["own"] = chunk["shared"].to_numpy()[least]
    else:
        root = (place[own] < 0).astype(bool)
        before = np.maximum(at - 1, 0)
        columns["parent1"] = np.where(root, 0, name1[before])
        columns["parent2"] = np.where(root, 0, name2[before])
        columns["depth"] = place[own] + 1
        columns["before"] = path[own]
        columns["n_convs"] = right - left + 1
    return pa.record_batch({k: pa.array(v) for k, v in columns.items()})


_NODE = "name1 long, name2 long, conv long, parent1 long, parent2 long, depth long, before long, n_convs long"
_SUMS = "name1 long, name2 long, conv long, shared long, leaf long, own long"


def _spread(bands: DataFrame, sums: bool) -> DataFrame:
    """Partial prefixes of sorted rows; copies of a conversation may lie in several partitions."""
    near = F.slice("hash1s", 1, 8)
    ranged = bands.repartitionByRange("band", "start1", near, "conv")
    ordered = ranged.sortWithinPartitions("band", "start1", "hash1s", "conv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            yield _partial(chunk, sums)

    return ordered.mapInArrow(run, _SUMS if sums else _NODE)


def _ends(last: DataFrame) -> DataFrame:
    """``name1, name2, ends_sha256`` of the ids of conversations that end at a prefix.

    A hash of a list runs from its first byte to its last, so the ids of a prefix pass
    through one task, but as a sorted stream: it never holds more than a batch of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            names = list(zip(batch.column("name1").to_pylist(), batch.column("name2").to_pylist(), strict=True))
            ids = [str(i) for i in batch.column("conv").to_pylist()]
            done: list[tuple] = []
            start = 0
            for at in range(1, len(names) + 1):
                if at < len(names) and names[at] == names[start]:
                    continue
                listed = ",".join(ids[start:at]).encode()
                if names[start] == now:
                    state.update(b"," + listed)
                else:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = names[start], hashlib.sha256(listed)
                start = at
            yield pa.record_batch(
                [pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))],
                names=["name1", "name2", "ends_sha256"],
            )
        if now is not None:
            yield pa.record_batch(
                [pa.array([now[0]]), pa.array([now[1]]), pa.array([state.hexdigest()])],
                names=["name1", "name2", "ends_sha256"],
            )

    dealt = last.repartition("name1", "name2").sortWithinPartitions("name1", "name2", "conv")
    return dealt.mapInArrow(run, "name1 long, name2 long, ends_sha256 string")


def prefix_trie(
    turns: DataFrame,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    group: int = GROUP,
    shared: Column | None = None,
    band: int = BAND,
) -> DataFrame:
    """A row per distinct prefix of the rebuilt conversations.

    ``conv_id`` (the least member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``. Turns are ordered by
    ``turn`` (missing first), then role, then text; equal rows are turns of their own. A
    missing role or text is empty. Rows without a conversation id belong to none and are
    left out. Conversations left without turns are members of the root alone. An empty table
    has no nodes, not even a root. Ids must be whole numbers; other columns are not read.
    """
    rows = _turn_rows(turns, key, turn, role, text)
    rebuilt, convs = rebuild(rows, group, shared)
    bands = _banded(rebuilt, convs, band)
    discard(rows, convs)
    keys = ["name1", "name2"]
    facts = [F.min(c).alias(c) for c in ("parent1", "parent2", "depth", "before")]
    partial = _spread(bands.drop("xor1", "xor2", "chars"), False)
    nodes = materialize(
        partial.groupBy(*keys).agg(F.min("conv").alias("conv"), *facts, F.sum("n_convs").alias("n_convs")), "nodes"
    )
    below = nodes.filter("depth > 0").groupBy(F.col("parent1").alias("name1"), F.col("parent2").alias("name2"))
    children = materialize(below.agg(F.count("*").alias("n_children")), "children")
    # A conversation's new prefixes are the deepest ones: from the first on it shares no more.
    fresh = nodes.groupBy("conv").agg(F.min_by("before", "depth").alias("new_from"))
    leaves = nodes.join(children, keys, "left_anti").select("conv", F.lit(1).alias("leaf"))
    whole = bands.groupBy("conv").agg(
        F.bit_xor("xor1").alias("name1"), F.bit_xor("xor2").alias("name2"), F.sum("chars").alias("total")
    )
    told = whole.join(fresh, "conv", "left").join(leaves, "conv", "left")
    told = materialize(
        told.select(
            "conv",
            *keys,
            F.coalesce("new_from", "total").alias("shared"),
            F.coalesce("leaf", F.lit(0)).cast("long").alias("leaf"),
        ),
        "told",
    )
    known = bands.drop("xor1", "xor2", "chars").join(told.select("conv", "shared", "leaf"), "conv")
    sums = _spread(known, True).groupBy(*keys).agg(
        F.sum("shared").alias("shared"),
        F.sum("leaf").alias("n_leaves"),
        F.min(F.struct("conv", "own")).alias("least"),
    )
    sums = materialize(sums.select(*keys, "shared", "n_leaves", F.col("least.own").alias("own")), "sums")
    ends = materialize(_ends(told), "ends")
    parents = nodes.select(
        F.col("name1").alias("parent1"), F.col("name2").alias("parent2"), F.col("conv").alias("parent_conv")
    )
    # The root is named by zeros and its own parent's name is the same: depth tells it apart.
    found = nodes.join(parents, ["parent1", "parent2"], "left")
    found = found.join(sums, keys).join(children, keys, "left").join(ends, keys, "left")
    saved = F.col("shared") - F.col("own") - (F.col("n_convs") - 1) * F.col("before")
    result = materialize(
        found.select(
            F.col("conv").alias("conv_id"),
            "depth",
            F.when(F.col("depth") > 0, F.col("parent_conv")).alias("parent_conv_id"),
            "n_convs",
            F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            "n_leaves",
            saved.alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        ),
        "trie",
    )
    discard(bands, nodes, children, told, sums, ends)
    return result


_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn
  FROM conversations WHERE conv_id IS NOT NULL
),
c AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role, text) AS own,
    conv_id - conv_id % 100 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT,
        list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))),
      4294967295::BIGINT) % 6 AS h
  FROM t GROUP BY conv_id
),
r AS (
  SELECT c.conv_id, list_concat(coalesce(b.own[1:c.h], []), c.own[c.h + 1:]) AS s
  FROM c LEFT JOIN c b ON b.conv_id = c.base
),
m AS (SELECT conv_id, len(s) AS n, d, s[1:d] AS p FROM r, unnest(generate_series(0, len(s))) AS g(d)),
n AS (
  SELECT p, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends
  FROM m GROUP BY p, d
),
k AS (SELECT p[1:depth - 1] AS p, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
f AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children,
    (n_convs - 1) * coalesce(length(n.p[n.depth].t), 0) AS saved
  FROM n LEFT JOIN k ON k.depth = n.depth AND k.p = n.p
),
u AS (
  SELECT f.p[1:d] AS p, d AS depth, sum(saved) AS saved, count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM f, unnest(generate_series(0, f.depth)) AS g(d) GROUP BY 1, 2
)
SELECT f.conv_id, f.depth, CAST(q.conv_id AS DOUBLE) AS parent_conv_id, f.n_convs, f.n_children, u.n_leaves,
  CAST(u.saved AS BIGINT) AS saved_tokens, f.ends AS ends_sha256
FROM f JOIN u ON u.depth = f.depth AND u.p = f.p
LEFT JOIN n q ON q.depth = f.depth - 1 AND q.p = f.p[1:f.depth - 1]
"""


@query("op13_prefix_trie", _SQL)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All prefixes of the rebuilt conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"))
