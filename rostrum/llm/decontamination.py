"""Benchmark decontamination by a broadcast hash set of normalised word n-grams.

The benchmark's windows become one set of 64-bit hashes with the windows behind them. A
task rolls the same hash over all word positions of its documents, looks the hashes up,
compares the words of every hit, and reports or removes what the hits cover. Documents
are never shuffled. A benchmark too large for one broadcast is cut into slices of
bounded size which are applied one after another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from rostrum.llm.common import mix64, sliced, table
from rostrum.llm.registry import query
from rostrum.session import materialize, shared_dir

# Words of a window; a shorter benchmark item is one window.
WINDOW = 13
# Benchmark text that is broadcast at once.
SLICE_BYTES = 16 << 20
# A document is contaminated if at least this share of its words is hit.
MIN_SHARE = 0.05

# A-Z become a-z, ASCII letters and digits and all other bytes from 0x80 stay, the rest
# separates words.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)
_HIT = "struct<item:string,start:int,stop:int>"
_ARROW_HITS = pa.list_(pa.struct([("item", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
_JUDGED = "n_words long, n_hit long, item_ids array<string>, contaminated boolean, clean_text string"
_VERDICT = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.bool_(), pa.string())


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


@dataclass
class Windows:
    """Benchmark windows by length: sorted hashes, and for a window its items."""

    ids: dict[bytes, int]
    hashes: dict[int, np.ndarray]
    items: dict[tuple[int, ...], tuple[str, ...]]


def _rolled(ids: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` ids from every position on."""
    factor, rolled = np.uint64(0x9E3779B97F4A7C15), np.zeros(max(0, len(ids) - width + 1), np.uint64)
    mixed = mix64(ids.astype(np.uint64) + np.uint64(1))
    for j in range(width):
        rolled *= factor
        rolled += mixed[j : j + len(rolled)]
    return rolled


def index_windows(items: list[tuple[str, str]], width: int = WINDOW) -> Windows:
    """Windows of ``(item_id, text)`` pairs; items without words have none."""
    ids: dict[bytes, int] = {}
    found: dict[tuple[int, ...], set[str]] = {}
    for item, text in items:
        own = [ids.setdefault(w, len(ids) + 1) for w in words_of(text)]
        size = min(width, len(own))
        for i in range(len(own) - size + 1 if size else 0):
            found.setdefault(tuple(own[i : i + size]), set()).add(item)
    hashes: dict[int, list[int]] = {}
    for window in found:
        rolled = _rolled(np.array(window), len(window))
        hashes.setdefault(len(window), []).append(int(rolled[0]))
    sorted_hashes = {n: np.unique(np.array(h, dtype=np.uint64)) for n, h in hashes.items()}
    return Windows(ids, sorted_hashes, {w: tuple(sorted(i)) for w, i in found.items()})


def find_windows(windows: Windows, docs: list[list[bytes]]) -> list[list[tuple[str, int, int]]]:
    """For each document the items that occur, with the first and last + 1 word."""
    found: list[list[tuple[str, int, int]]] = [[] for _ in docs]
    get = windows.ids.get
    # 0 stands for any word the benchmark doesn't have and keeps documents apart.
    flat = np.fromiter(
        (i for words in docs for i in [*map(get, words, [0] * len(words)), 0]), dtype=np.int64
    )
    ends = np.cumsum([len(words) + 1 for words in docs])
    unknown = np.append(0, np.cumsum(flat == 0))
    for width, hashes in windows.hashes.items():
        if len(flat) < width:
            continue
        whole = np.flatnonzero(unknown[width:] == unknown[:-width])
        if not len(whole):
            continue
        rolled = _rolled(flat, width)[whole]
        at = np.minimum(np.searchsorted(hashes, rolled), len(hashes) - 1)
        for start in whole[hashes[at] == rolled].tolist():
            for item in windows.items.get(tuple(flat[start : start + width].tolist()), ()):
                doc = int(np.searchsorted(ends, start, side="right"))
                begin = start - (int(ends[doc - 1]) if doc else 0)
                found[doc].append((item, begin, begin + width))
    return found


def _slices(
    benchmark: DataFrame, item: str, text: str, limit: int
) -> Iterator[Callable[[], list[tuple[str, str]]]]:
    """The items in lists of about ``limit`` bytes; each is collected when it is called for."""
    rows = benchmark.select(
        F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")).alias("item"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    ).distinct()
    size = rows.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    count = max(1, -(-size // limit))
    for k in range(count):
        part = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k)
        yield lambda part=part: [(r["item"], r["text"]) for r in part.collect()]


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    width: int = WINDOW,
    slice_bytes: int = SLICE_BYTES,
    column: str = "hits",
) -> DataFrame:
    """The documents, all columns kept, with an array of hits: item, first word, last + 1.

    A column of that name is replaced. A missing or empty text has no words and no hits;
    items without words never hit; a missing item id counts as ''. Repeated
    rows are judged one by one. With an empty benchmark nothing hits.
    """
    return _search(docs, benchmark, text, item, item_text, width, slice_bytes, column)


def judge(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    width: int = WINDOW,
    slice_bytes: int = SLICE_BYTES,
    min_share: float = MIN_SHARE,
) -> DataFrame:
    """The documents with ``n_words``, ``n_hit``, ``item_ids``, ``contaminated``, ``clean_text``.

    ``contaminated``: at least one word is hit and at least ``min_share`` of all.
    ``clean_text``: the text without the hit spans; the text itself if there is none.
    Columns of these names are replaced; rows, texts and items are taken as by
    :func:`find_hits`.
    """
    docs = docs.drop(*(part.split()[0] for part in _JUDGED.split(", ")))
    share = Fraction(str(min_share))
    return _search(docs, benchmark, text, item, item_text, width, slice_bytes, "__hits", share)


def _search(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str,
    item: str,
    item_text: str,
    width: int,
    slice_bytes: int,
    column: str,
    share: Fraction | None = None,
) -> DataFrame:
    """Hits of one slice of the benchmark after another; the last pass judges them, too."""
    spark = docs.sparkSession
    docs = docs.drop(column)
    hits_field = spark.createDataFrame([], f"`{column}` array<{_HIT}>").schema.fields
    with_hits = StructType([*docs.schema.fields, *hits_field])
    judged = StructType([*docs.schema.fields, *spark.createDataFrame([], _JUDGED).schema.fields])
    out = docs.withColumn(column, F.lit(None).cast(f"array<{_HIT}>"))
    slices = list(_slices(benchmark, item, item_text, slice_bytes))
    for number, collect in enumerate(slices):
        if number:
            out = materialize(out, "hits")
        windows = spark.sparkContext.broadcast(index_windows(collect(), width))
        last = share is not None and number == len(slices) - 1

        def scan(
            batches: Iterator[pa.RecordBatch], windows=windows, last=last
        ) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, text):
                texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
                words = [words_of(t or "") for t in texts]
                place = batch.schema.get_field_index(column)
                before = batch.column(place)
                hits = [
                    [*(old or ()), *({"item": i, "start": a, "stop": b} for i, a, b in new)]
                    for old, new in zip(before.to_pylist(), find_windows(windows.value, words), strict=True)
                ]
                if last:
                    rows = [_verdict(t, len(w), h, share) for t, w, h in zip(texts, words, hits, strict=True)]
                    kept = [i for i in range(batch.num_columns) if i != place]
                    columns = [batch.column(i) for i in kept]
                    names = [batch.schema.names[i] for i in kept] + judged.names[len(kept) :]
                    columns += [
                        pa.array([r[k] for r in rows], type=kind) for k, kind in enumerate(_VERDICT)
                    ]
                    yield pa.record_batch(columns, names=names)
                else:
                    yield batch.set_column(place, column, pa.array(hits, type=_ARROW_HITS))

        out = out.mapInArrow(scan, judged if last else with_hits)
    return out


def _verdict(text: str | None, n: int, hits: list[dict], share: Fraction) -> tuple:
    spans = _covered(hits)
    n_hit = sum(stop - start for start, stop in spans)
    enough = n_hit * share.denominator >= n * share.numerator
    items = sorted({h["item"] for h in hits})
    return n, n_hit, items, n_hit > 0 and enough, _without(text, spans) if spans else text


def _covered(hits: list[dict]) -> list[tuple[int, int]]:
    """Hit word ranges, merged and in order."""
    merged: list[list[int]] = []
    for start, stop in sorted((h["start"], h["stop"]) for h in hits):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(stop, merged[-1][1])
        else:
            merged.append([start, stop])
    return [tuple(m) for m in merged]


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what lies between them."""
    folded, bounds, at = text.encode().translate(_FOLD), [], 0
    for word in folded.split():
        at = folded.index(word, at)
        bounds.append((at, at + len(word)))
        at += len(word)
    raw, kept, at = text.encode(), [], 0
    for start, stop in spans:
        kept.append(raw[at : bounds[start][0]])
        at = bounds[stop - 1][1]
    return b"".join([*kept, raw[at:]]).decode()


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    remove: str = "documents",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    width: int = WINDOW,
    min_share: float = MIN_SHARE,
) -> DataFrame:
    """The documents without contaminated rows, or with the hit spans cut out of them.

    Columns stay as they were. ``remove="spans"`` cuts every hit span out of contaminated
    documents and keeps all rows.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"unknown removal {remove!r}")
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    content = f"c{names.index(text)}"
    judged = judge(plain, benchmark, content, item, item_text, width, min_share=min_share)
    if remove == "documents":
        kept = judged.filter(~F.col("contaminated"))
    else:
        clean = F.when(F.col("contaminated"), F.col("clean_text")).otherwise(F.col(content))
        kept = judged.withColumn(content, clean)
    return kept.select(plain.columns).toDF(*names)


_WORDS = (
    "regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
_SQL = f"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS.format(text="text")} AS w FROM benchmark
),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n,
         array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS window_words
  FROM items, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS t(i)
  WHERE len(w) > 0
),
docs AS (
  SELECT doc_id, coalesce({_WORDS.format(text="text")}, []) AS w FROM documents
),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS window_words
  FROM docs, lengths, unnest(generate_series(1, len(w) - n + 1)) AS t(i)
),
found AS (
  SELECT p.doc_id, p.i, p.n, windows.item_id FROM places p JOIN windows USING (n, window_words)
),
hits AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit
  FROM found, unnest(generate_series(i, i + n - 1)) AS t(j) GROUP BY doc_id
),
hit_items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         sha256(string_agg(DISTINCT item_id, ',' ORDER BY item_id)) AS items_sha256
  FROM found GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


@query("op4_decontamination", _SQL)
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document is benchmark text, and whether it is contaminated."""
    shared_dir(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = judge(docs, table(spark, sf_dir, "benchmark"))
    return judged.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        "contaminated",
    )
