"""Token ids, token files and packing against the tokenizer itself."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from rostrum.llm.packing import FirstFit, first_fit_decreasing, pack
from rostrum.llm.token_files import id_checksums, read_token_files, write_token_files
from rostrum.llm.tokens import WordEncoder, vocabulary_path

ODD = [
    None,
    "",
    " ",
    "\n\n",
    "don't stop, it's the U.S.A.'s 42nd 'quoted' word's!",
    "a\tb c d\x1ce\x85f",
    "<|endoftext|> x<|startoftext|>y <|endoftext|>.",
    "ÀÉÎ straße İstanbul ǅ Ωmega ΟΔΟΣ éa ﬁn ×÷ 日本語 한글 🙂!",
    "x" * 5000,
    "word&&& word*** word... .word __init__ a_b 3.14 e=mc²",
    "the the the\nthe",
]


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(vocabulary_path())


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def plain(whole, texts):
    return [whole.encode(t or "", add_special_tokens=False).ids for t in texts]


def check(encoder, whole, texts, end_id=None):
    ids, ends = encoder.encode(pa.array(texts, pa.string()), end_id)
    tail = [] if end_id is None else [end_id]
    expected = [x + tail for x in plain(whole, texts)]
    assert [x.tolist() for x in np.split(ids, ends)[:-1]] == expected


def test_encoder_equals_tokenizer(whole):
    encoder = WordEncoder(vocabulary_path())
    check(encoder, whole, ODD, 1)
    check(encoder, whole, ODD)
    check(encoder, whole, [chr(c) for c in range(1, 0x600)])
    check(encoder, whole, [f"a{chr(c)}B{chr(c)}, x" for c in range(1, 0x600)])


def test_encoder_forgets_words_and_stays_right(whole):
    encoder = WordEncoder(vocabulary_path(), cache_words=3)
    for _ in range(3):
        check(encoder, whole, ["one two three four, five", "six one Two"], 2)


def test_encoder_for_other_vocabularies():
    path = vocabulary_path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    check(WordEncoder(path, words=False), whole, ODD, 7)
    with pytest.raises(ValueError, match="ends of words"):
        WordEncoder(path)


@pytest.mark.parametrize("encoding", ["delta", "dictionary"])
def test_token_files_round_trip(spark, documents, whole, tmp_path, encoding):
    rows = [(i * 3, t) for i, t in enumerate(ODD)] + [(None, "first of all"), (6, "again"), (6, "again")]
    path = str(tmp_path / "files")
    write_token_files(documents(rows), path, vocabulary_path(), encoding=encoding, file_bytes=2000)
    found = read_token_files(spark, path).orderBy("start").collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.tokens) for r in found) == sorted(
        (i is not None, i or 0, plain(whole, [t])[0] + [1]) for i, t in rows
    )
    at = 0
    for r in found:
        assert r.start == at and r.n_tokens == len(r.tokens)
        at += r.n_tokens
    keys = [r.doc_id for r in found]
    assert keys[0] is None and keys[1:] == sorted(keys[1:])
    sums = id_checksums(read_token_files(spark, path)).collect()
    assert sorted((r.start, r.ids_crc32) for r in sums) == [(r.start, crc(r.tokens)) for r in found]


def test_token_files_layout(documents, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(str(rng.random()) for _ in range(100))) for i in range(300)]
    path = tmp_path / "files"
    write_token_files(
        documents(rows), str(path), vocabulary_path(), row_group_bytes=64 << 10, page_bytes=8 << 10
    )
    files = [pq.ParquetFile(p) for p in sorted(path.glob("*.parquet"))]
    columns = [f.metadata.row_group(0).column(4) for f in files if f.metadata.num_rows]
    assert columns and all("DELTA_BINARY_PACKED" in c.encodings for c in columns)
    assert all(c.has_offset_index for c in columns)
    assert sum(f.metadata.num_row_groups for f in files) > 1


def test_token_files_of_an_empty_table(spark, documents, tmp_path):
    path = str(tmp_path / "files")
    write_token_files(documents([]), path, vocabulary_path())
    assert id_checksums(read_token_files(spark, path)).collect() == []


def test_first_fit_decreasing_equals_a_plain_search():
    rng = random.Random(1)
    for _ in range(50):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(0, 60))]
        bins, offsets = first_fit_decreasing(np.array(sizes, dtype=np.int64), 100)
        room, expected = [], {}
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            at = next((b for b, free in enumerate(room) if free >= sizes[i]), len(room))
            if at == len(room):
                room.append(100)
            expected[i] = (at, 100 - room[at])
            room[at] -= sizes[i]
        assert {i: (int(b), int(o)) for i, (b, o) in enumerate(zip(bins, offsets))} == expected
    assert FirstFit(1, 5).place(5) == (0, 0)


def check_packing(found, rows, whole, capacity):
    """Every id in one piece, sequences gapless and within the capacity."""
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append(plain(whole, [t])[0] + [2])
    sequences, pieces = {}, {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    for key, texts in ids.items():
        expected = [
            (s, min(capacity, len(x) - s), crc(x[s : s + capacity]), len(x))
            for x in texts
            for s in range(0, len(x), capacity)
        ]
        assert sorted(pieces.pop(key)) == sorted(expected)
    assert not pieces
    return sequences


def test_packing_covers_every_id_once(documents, whole):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "lost"), (3, "again"), (3, "again")]
    rows += [(100 + i, "many words " * i) for i in range(1, 60)]
    found = pack(documents(rows), vocabulary_path(), capacity=64, group_documents=20).collect()
    check_packing(found, rows, whole, 64)


def test_packing_pads_little(documents, whole):
    rng = random.Random(2)
    rows = [(i, "word " * rng.randint(1, 60)) for i in range(600)]
    found = pack(documents(rows), vocabulary_path(), capacity=64, group_documents=300).collect()
    sequences = check_packing(found, rows, whole, 64)
    assert sum(r.length for r in found) >= 0.97 * 64 * len(sequences)


def test_packing_of_an_empty_table(documents):
    assert pack(documents([]), vocabulary_path()).collect() == []
