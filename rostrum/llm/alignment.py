"""Alignment of two tokenizers' tokens over the same bytes.

The tokens of a byte-level vocabulary (A) and of a piece vocabulary (B) cover the same bytes
of a text. Tokens that overlap are linked; where a token of A and one of B end at the same
byte, a group of linked tokens ends. Every token points to the farthest-right token that
overlaps it. Following the successor's successor doubles the step, so after a number of
rounds that is the logarithm of the longest group every token points to the last token of
its group, which labels the group. All texts of a batch are done at once.

Neither vocabulary has a token that goes on behind a letter or mark into a blank, so a blank
between two of these always starts a new token in both, and texts fall into units there.
Each distinct unit of a block of documents is encoded and aligned once.

How often a pair of ids is linked in the corpus is counted as in a join of blocks with
buckets: a block of documents sends each bucket its distinct pairs with the number of its
documents that hold them, all pairs of an A id to the same bucket, and gets the sums back,
with a mark at each A id's most frequent pairs. Nothing is shuffled per token.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from rostrum.llm.common import expand, fan_out, freeing, mix64, sliced, table, text_bytes
from rostrum.llm.packed import pack, pack_sorted, unpack, unpack_sorted
from rostrum.llm.registry import query
from rostrum.llm.tokens import vocabulary_path
from rostrum.session import materialize

BYTES_VOCABULARY = "byte_bpe_50k.json"
PIECES_VOCABULARY = "piece_bpe_32k.model"
# Text of a block of documents, and of the corpus per bucket of pairs.
BLOCK_BYTES = 6 << 20
BUCKET_BYTES = 64 << 20
# Units that are encoded at a time.
UNITS_AT_ONCE = 20_000

# What a blank between two units has on either side.
_EDGE = r"[!-~\p{L}]"
_BINARIES = pa.list_(pa.binary())


def _byte_letters() -> dict[str, int]:
    """Letters by which byte-level vocabularies spell bytes: printable ones stand for themselves."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spelled = {chr(b): b for b in plain}
    others = [b for b in range(256) if b not in plain]
    return spelled | {chr(256 + k): b for k, b in enumerate(others)}


class Aligner:
    """Both tokenizers, and the number of bytes of each of their tokens."""

    def __init__(self, bytes_path: str, pieces_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(bytes_path)
        self.first.encode_special_tokens = True
        letters = _byte_letters()
        vocabulary = self.first.get_vocab()
        # A special token has no bytes of a text.
        self.first_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if all(c in letters for c in token):
                self.first_bytes[i] = bytes(letters[c] for c in token)
        self.second = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.second_bytes: list[bytes] = []
        for i, piece in enumerate(pieces):
            byte = re.fullmatch(r"<0x([0-9A-F]{2})>", piece) if self.second.is_byte(i) else None
            self.second_bytes.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())
        self.first_sizes, self.second_sizes = (np.array([*map(len, x)]) for x in (self.first_bytes, self.second_bytes))
        self.decimal = [*map(str, range(max(len(self.first_bytes), len(self.second_bytes))))]
        # A piece that crosses from a letter or mark to a blank would undo the cut into units.
        crossing = [t for t in (*self.first_bytes, *self.second_bytes) if re.search(rb"[^ \t-\r\x1c-\x1f\x85\xa0] ", t)]
        self.cuts = not crossing

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        first = self.first.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        return [e.ids for e in first], self.second.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def aligner(bytes_path: str, pieces_path: str) -> Aligner:
    """One per worker process and pair of vocabularies."""
    return Aligner(bytes_path, pieces_path)


def group_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Group labels of tokens that cover the same bytes, and the first and last link of A tokens.

    ``a_ends`` and ``b_ends`` are where the tokens end, ascending, with the same last value.
    Labels are places of the group's terminal token among those of B. The links of an A
    token are to the B tokens from its first to its last.
    """
    a_starts, b_starts = (np.append(0, e[:-1]) if len(e) else e for e in (a_ends, b_ends))
    first = np.searchsorted(b_ends, a_starts, side="right")
    last = np.searchsorted(b_ends, a_ends, side="left")
    # Successors: A tokens are 0..., B tokens follow. A token of B that ends with one of A
    # is the farther one, so a group's last token of B points to itself.
    n = len(a_ends)
    over = np.searchsorted(a_ends, b_ends, side="left")
    reach = np.where(a_ends[over] > b_ends, over, n + np.arange(len(b_ends))) if len(b_ends) else over
    successor = np.concatenate((n + last, reach))
    while True:
        further = successor[successor]
        if np.array_equal(further, successor):
            return successor[:n] - n, successor[n:] - n, first, last
        successor = further


class _Units:
    """Distinct units of a block: their tokens, groups and links."""

    def __init__(self, tools: Aligner, units: list[str]):
        count = len(units)
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.zeros(count, dtype=np.int64) for _ in range(4))
        self.valid = np.zeros(count, dtype=bool)
        self.spelled = np.full(count, "", dtype=object)
        links: list[np.ndarray] = [np.empty(0, dtype=np.uint64)]
        for start in range(0, count, UNITS_AT_ONCE):
            part = units[start : start + UNITS_AT_ONCE]
            sides = tools.encode(part)
            good = _given_back(tools, part, *sides)
            at = start + good
            self.valid[at] = True
            if len(good) < len(part):
                sides = tuple([ids[k] for k in good.tolist()] for ids in sides)
            if len(good):
                links.append(self._align(tools, at, *sides))
        self.links = np.concatenate(links)

    def _align(self, tools: Aligner, at: np.ndarray, firsts: list[list[int]], seconds: list[list[int]]) -> np.ndarray:
        """Counts and spellings of the units; returns their linked pairs, unit after unit."""
        a_sizes, b_sizes = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (firsts, seconds))
        a, b = _flat(firsts), _flat(seconds)
        a_ends, b_ends = np.cumsum(tools.first_sizes[a]), np.cumsum(tools.second_sizes[b])
        a_label, b_label, first, last = group_ends(a_ends, b_ends)
        a_unit, b_unit = np.repeat(np.arange(len(at)), a_sizes), np.repeat(np.arange(len(at)), b_sizes)
        terminal = np.flatnonzero(b_label == np.arange(len(b)))
        degree = last - first + 1
        self.n_a[at], self.n_b[at] = a_sizes, b_sizes
        self.n_groups[at] = np.bincount(b_unit[terminal], minlength=len(at))
        self.n_links[at] = np.bincount(a_unit, weights=degree, minlength=len(at)).astype(np.int64)
        # All tokens by group, those of A first; what follows each tells where groups and units end.
        group = np.concatenate([np.searchsorted(terminal, label) for label in (a_label, b_label)])
        order = np.argsort(2 * group + np.repeat([0, 1], [len(a), len(b)]), kind="stable")
        ids, group = np.concatenate((a, b))[order].tolist(), group[order]
        side, unit = order >= len(a), np.concatenate((a_unit, b_unit))[order]
        mark = np.where(side[1:] != side[:-1], 1, 0)
        mark[group[1:] != group[:-1]] = 2
        mark[unit[1:] != unit[:-1]] = 3
        marks = [",|;\n"[k] for k in mark.tolist()]
        spelled = [""] * (2 * len(ids) - 1)
        spelled[::2], spelled[1::2] = [tools.decimal[i] for i in ids], marks
        self.spelled[at] = "".join(spelled).split("\n")
        return (np.repeat(a, degree).astype(np.uint64) << np.uint64(32)) | b[expand(first, degree)].astype(np.uint64)


def _flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), dtype=np.int64)


def _given_back(tools: Aligner, units: list[str], firsts: list[list[int]], seconds: list[list[int]]) -> np.ndarray:
    """Places of the units that both tokenizers give back byte for byte, after a blank."""
    wanted = [b" " + u.encode() for u in units]
    sizes = np.fromiter(map(len, wanted), np.int64, len(wanted))
    whole, same = b"".join(wanted), True
    for lists, spelled, lengths in (
        (firsts, tools.first_bytes, tools.first_sizes),
        (seconds, tools.second_bytes, tools.second_sizes),
    ):
        ids = _flat(lists)
        ends = np.append(0, np.cumsum(lengths[ids]))[np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))]
        same = same and np.array_equal(ends, np.cumsum(sizes)) and b"".join([spelled[i] for i in ids.tolist()]) == whole
    if same:
        return np.arange(len(units))
    return np.array(
        [
            k
            for k, (unit, a, b) in enumerate(zip(wanted, firsts, seconds, strict=True))
            if b"".join([tools.first_bytes[i] for i in a]) == unit == b"".join([tools.second_bytes[i] for i in b])
        ],
        dtype=np.int64,
    )


def _cut(texts: pa.Array, cuts: bool) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct units of the texts, the units of all texts in order, and how many each text has.

    An empty text has none. The blank before a unit, the first one's included, is left out.
    """
    if not cuts:
        coded = texts.dictionary_encode()
        filled = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        return coded.dictionary.to_pylist(), coded.indices.to_numpy()[filled], filled.astype(np.int64)
    lists = pc.split_pattern(texts, " ")
    parts = pc.list_flatten(lists).dictionary_encode()
    distinct = parts.dictionary
    place = parts.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    opens, closes = (
        pc.match_substring_regex(distinct, p).to_numpy(zero_copy_only=False) for p in ("^" + _EDGE, _EDGE + "$")
    )
    begins = np.zeros(len(place), dtype=bool)
    begins[1:] = closes[place[:-1]] & opens[place[1:]]
    begins[np.cumsum(counts) - counts] = True
    starts = np.flatnonzero(begins)
    lengths = np.diff(np.append(starts, len(place)))
    units = distinct.to_pylist()
    found = place[starts]
    # Parts that may not be parted are joined again.
    known = {u: k for k, u in enumerate(units)}
    for k in np.flatnonzero(lengths > 1).tolist():
        joined = " ".join([units[p] for p in place[starts[k] : starts[k] + lengths[k]].tolist()])
        found[k] = known.setdefault(joined, len(known))
    units = list(known)
    text = np.repeat(np.arange(len(counts)), counts)[starts]
    filled = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    kept = filled[text]
    found, text = found[kept], text[kept]
    used, found = np.unique(found, return_inverse=True)
    return [units[k] for k in used.tolist()], found, np.bincount(text, minlength=len(counts)).astype(np.int64)


def _distinct(owner: np.ndarray, value: np.ndarray, values: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct combinations of an owner and a value below ``values``."""
    joined = np.sort(owner.astype(np.int64) * values + value)
    joined = joined[np.append(True, joined[1:] != joined[:-1])[: len(joined)]]
    return joined // values, joined % values


_ROW = (
    "block long, bucket int, pairs binary, counts binary, units binary, links binary, places binary, "
    "facts array<binary>, spelled array<string>"
)


def _row_schema(key: pa.DataType) -> pa.Schema:
    return pa.schema(
        [
            ("block", pa.int64()),
            ("bucket", pa.int32()),
            ("pairs", pa.binary()),
            ("counts", pa.binary()),
            ("units", pa.binary()),
            ("links", pa.binary()),
            ("places", pa.binary()),
            ("facts", _BINARIES),
            ("spelled", pa.list_(pa.string())),
            ("keys", pa.list_(key)),
        ]
    )


def _rows(batch: dict[str, list], schema: pa.Schema, count: int) -> pa.RecordBatch:
    return pa.record_batch(
        [batch[f.name] if f.name in batch else pa.nulls(count, f.type) for f in schema], schema=schema
    )


def _block_rows(tools: Aligner, block: int, texts: pa.Array, keys: pa.Array, buckets: int) -> Iterator[pa.RecordBatch]:
    """A row of a block's documents, and one for each bucket its pairs fall into."""
    names, found, counts = _cut(texts, tools.cuts)
    units = _Units(tools, names)
    text = np.repeat(np.arange(len(counts)), counts)
    broken = np.bincount(text, weights=~units.valid[found], minlength=len(counts)) > 0
    good = ~broken[text]
    found, text = found[good], text[good]
    sizes = np.bincount(text, minlength=len(counts)).astype(np.int64)
    sums = [
        np.bincount(text, weights=n[found], minlength=len(counts)).astype(np.int64)
        for n in (units.n_a, units.n_b, units.n_groups, units.n_links)
    ]
    spelled, ends = units.spelled[found].tolist(), np.cumsum(sizes).tolist()
    hashes = [
        hashlib.sha256(";".join(spelled[a:z]).encode()).hexdigest() if a < z else ""
        for a, z in zip([0, *ends], ends, strict=False)
    ]
    pairs, link = np.unique(units.links, return_inverse=True)
    # Documents of each pair: a document's distinct units, then their distinct pairs.
    unit_of = np.repeat(np.arange(len(names)), units.n_links)
    own_unit, own_pair = _distinct(unit_of, link, max(1, len(pairs)))
    per_unit = np.bincount(own_unit, minlength=len(names))
    begin = np.cumsum(per_unit) - per_unit
    documents = np.zeros(len(pairs), dtype=np.int64)
    of, unit = _distinct(text, found, max(1, len(names)))
    for part in np.array_split(np.arange(len(counts)), 1 + int(per_unit[unit].sum()) // (4 << 20)):
        inside = slice(*np.searchsorted(of, [part[0], part[-1] + 1])) if len(part) else slice(0, 0)
        pair = own_pair[expand(begin[unit[inside]], per_unit[unit[inside]])]
        document = np.repeat(of[inside], per_unit[unit[inside]])
        documents += np.bincount(_distinct(document, pair, max(1, len(pairs)))[1], minlength=len(pairs))
    # Pairs of units that only stand in texts without tokens are no pairs of the corpus.
    bucket = (mix64(pairs >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((pairs, bucket))
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    schema = _row_schema(keys.type)
    yield _rows(
        {
            "block": pa.array([block]),
            "units": pa.array([pack(sizes)]),
            "links": pa.array([pack(units.n_links)]),
            "places": pa.array([pack(place[link])]),
            "facts": pa.array([[pack(found), *map(pack, sums)]], _BINARIES),
            "spelled": pa.array([hashes], pa.list_(pa.string())),
            "keys": pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
        },
        schema,
        1,
    )
    cuts = np.append(np.searchsorted(bucket[order], np.arange(buckets)), len(order)).tolist()
    asked = [(b, a, z) for b, (a, z) in enumerate(zip(cuts, cuts[1:])) if a < z]
    yield _rows(
        {
            "block": pa.array([block] * len(asked), pa.int64()),
            "bucket": pa.array([b for b, _, _ in asked], pa.int32()),
            "pairs": pa.array([pack_sorted(pairs[order[a:z]]) for _, a, z in asked], pa.binary()),
            "counts": pa.array([pack(documents[order[a:z]]) for _, a, z in asked], pa.binary()),
        },
        schema,
        len(asked),
    )


def _requests(docs: DataFrame, buckets: int, block_bytes: int, paths: tuple[str, str]) -> DataFrame:
    """Stored rows of two kinds: a block's documents (no bucket), and its pairs by bucket."""
    kind = docs.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tools = TaskContext.get().partitionId(), aligner(*paths)
        held, taken, number = [], 0, 0
        for batch in sliced(batches, "text"):
            held.append(batch)
            taken += batch.column("text").nbytes
            if taken >= block_bytes:
                yield from block(tools, (part << 32) + number, held)
                held, taken, number = [], 0, number + 1
        if held:
            yield from block(tools, (part << 32) + number, held)

    def block(tools: Aligner, number: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = pc.fill_null(pa.concat_arrays([b.column("text").cast(pa.string()) for b in held]), "")
        keys = pa.concat_arrays([b.column("key") for b in held])
        yield from _block_rows(tools, number, texts, keys, buckets)

    return materialize(docs.mapInArrow(run, f"{_ROW}, keys array<{kind}>"), "pairs")


def _answers(requests: DataFrame) -> DataFrame:
    """For every block and bucket, how many documents have its pairs, and which are best."""

    @freeing
    def run(group: pa.Table) -> pa.Table:
        own = [unpack_sorted(p) for p in group["pairs"].to_pylist()]
        counts = np.concatenate([unpack(c) for c in group["counts"].to_pylist()]).astype(np.int64)
        pairs, place = np.unique(np.concatenate(own), return_inverse=True)
        sums = np.zeros(len(pairs), dtype=np.int64)
        np.add.at(sums, place, counts)
        first = pairs >> np.uint64(32)
        begins = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
        most = np.repeat(np.maximum.reduceat(sums, begins), np.diff(np.append(begins, len(first))))
        # The count doubled, one more for a best pair.
        told = 2 * sums + (sums == most)
        ends = np.cumsum([len(p) for p in own])
        answers = [pack(told[place[e - len(p) : e]]) for p, e in zip(own, ends, strict=True)]
        return pa.table(
            {
                "block": group["block"].combine_chunks(),
                "bucket": group["bucket"].combine_chunks(),
                "counts": pa.array(answers, pa.binary()),
            }
        )

    asked = requests.filter("bucket IS NOT NULL").select("block", "bucket", "pairs", "counts")
    return asked.groupBy("bucket").applyInArrow(run, "block long, bucket int, counts binary")


def align(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    bytes_path: str | None = None,
    pieces_path: str | None = None,
    block_bytes: int = BLOCK_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Key, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    Texts that are missing or empty, or that either tokenizer does not give back byte for
    byte with a blank before, have no tokens: zeros and an empty hash. Special tokens'
    strings are plain text. A pair's count is the number of rows that hold it linked, so a
    repeated row counts each time; rows with missing or repeated keys take part. Other
    columns are not read. An empty table gives no rows.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    paths = (bytes_path or vocabulary_path(BYTES_VOCABULARY), pieces_path or vocabulary_path(PIECES_VOCABULARY))
    block_bytes, bucket_bytes, buckets = fan_out(text_bytes(docs, text), block_bytes, bucket_bytes)
    kind = rows.schema["key"].dataType.simpleString()
    requests = _requests(rows, buckets, block_bytes, paths)

    @freeing
    def run(group: pa.Table) -> pa.Table:
        own = group.filter(pc.is_null(group["bucket"]))
        replies = group.filter(pc.is_valid(group["bucket"])).sort_by("bucket")["counts"].to_pylist()
        told = np.concatenate([np.empty(0, np.uint64), *map(unpack, replies)]).astype(np.int64)
        sizes = unpack(own["units"][0].as_py()).astype(np.int64)
        links = unpack(own["links"][0].as_py()).astype(np.int64)
        places = unpack(own["places"][0].as_py()).astype(np.int64)
        found, *sums = (unpack(f).astype(np.int64) for f in own["facts"][0].as_py())
        answers = told[places]
        ends, stops = np.cumsum(links), np.cumsum(sizes)
        for value in (answers & 1, answers >> 1):
            total = np.append(0, np.cumsum(value))
            by_unit = (total[ends] - total[ends - links])[found]
            running = np.append(0, np.cumsum(by_unit))
            sums.append(running[stops] - running[stops - sizes])
        names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
        return pa.table(
            {
                "key": pc.list_flatten(own["keys"]).combine_chunks(),
                **{n: pa.array(s) for n, s in zip(names, sums, strict=True)},
                "groups_sha256": pc.list_flatten(own["spelled"]).combine_chunks(),
            }
        )

    documents = requests.filter("bucket IS NULL").drop("pairs", "counts")
    met = documents.unionByName(_answers(requests), allowMissingColumns=True)
    found = met.groupBy("block").applyInArrow(
        run,
        f"key {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
        "groups_sha256 string",
    )
    return found.withColumnRenamed("key", key)


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two public vocabularies over every text."""
    return align(table(spark, sf_dir, "documents"))
