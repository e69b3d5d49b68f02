"""Order MinHash against a plain version, and the order of documents."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from rostrum.llm.common import mix64
from rostrum.llm.order_minhash import (
    _kmer_hashes,
    edited_pairs,
    fingerprint,
    fingerprints,
    likeness,
)


def plain(text, k=8, components=64, picked=2):
    """The same signature, occurrence by occurrence."""
    if not text:
        return [0] * components
    codes = np.array([ord(c) for c in text], dtype=np.uint32)
    factor = np.uint64(0x9E3779B97F4A7C15)
    seen, bins = {}, {}
    for place, h in enumerate((_kmer_hashes(codes, k) >> np.uint64(24)).tolist()):
        number = seen[h] = seen.get(h, -1) + 1
        value = int(mix64(np.array([np.uint64(h) * factor + np.uint64(number)]))[0]) >> 24
        bins.setdefault(value >> 34, []).append((value, place))
    out = [0] * components
    for b, own in bins.items():
        chosen = sorted(sorted(own)[:picked], key=lambda x: x[1])
        values = [v for v, _ in chosen] + [0] * (picked - len(chosen))
        hashed = np.zeros(1, dtype=np.uint64)
        for j, v in enumerate(values):
            hashed = mix64(hashed * factor + np.uint64(v) + np.uint64(j + 1))
        out[b] = max(int(hashed[0]) >> 32, 1)
    return out


@pytest.mark.parametrize("text", ["", "a", "abcdefg", "abababababababababab" * 9, "Ünï 🙂 text of some words " * 7])
def test_equals_plain_version(text):
    with np.errstate(over="ignore"):
        assert fingerprint(text).tolist() == plain(text)


def test_random_texts_equal_plain_version():
    rng = random.Random(5)
    for _ in range(30):
        text = "".join(rng.choices("abc ", k=rng.randint(1, 700)))
        with np.errstate(over="ignore"):
            assert fingerprint(text).tolist() == plain(text)


def test_kmer_hashes_are_a_function_of_the_kmer():
    codes = np.array([ord(c) for c in "abcdefghijklm" + "x" + "abcdefghijklm"], dtype=np.uint32)
    for k in range(1, 13):
        hashes = _kmer_hashes(codes, k)
        assert len(hashes) == len(codes) - k + 1
        assert hashes[0] == hashes[14] and len(set(hashes.tolist())) == len({tuple(codes[i : i + k]) for i in range(len(hashes))})


def test_likeness_falls_with_edits_and_feels_order():
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(600)]
    text = " ".join(words)
    near = [likeness(fingerprint(text), fingerprint(" ".join(words[:n] + words[:0] + words[n + 60 :]))) for n in (100, 300)]
    half = " ".join(words[300:] + words[:300])
    other = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(600))
    assert likeness(fingerprint(text), fingerprint(text)) == 1
    assert all(0.6 < n < 1 for n in near)
    assert 0.2 < likeness(fingerprint(text), fingerprint(half)) < 0.8
    assert likeness(fingerprint(text), fingerprint(other)) < 0.05
    assert likeness(fingerprint(""), fingerprint("")) == 1


def test_every_document_meets_the_next(documents, monkeypatch):
    from rostrum.llm import order_minhash

    monkeypatch.setattr(order_minhash, "RANGE_BYTES", 300)
    rng = random.Random(7)
    rows = [(i * 7 - 300, "".join(rng.choices("abcd é🙂", k=rng.randint(0, 90)))) for i in range(100)]
    rows += [(None, "no key"), (400, None), (401, ""), (50, "twice"), (50, "twice"), (402, "long " * 30000)]
    rng.shuffle(rows)
    found = edited_pairs(documents(rows)).collect()
    order = sorted(((i if i is not None else -(1 << 63), t or "", i) for i, t in rows), key=lambda r: (r[0], r[1].encode()))
    expected = []
    for at, (_, text, key) in enumerate(order):
        after = order[(at + 1) % len(order)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        one, two, three = fingerprint(text), fingerprint(edited), fingerprint(after)
        expected.append(
            (key, len(text), hashlib.sha256(edited.encode()).hexdigest(), one.tobytes().hex(), two.tobytes().hex(), likeness(one, two), likeness(one, three))
        )
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)


def test_single_row_and_empty_table(documents):
    (row,) = edited_pairs(documents([(9, "abcdefgh")])).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    assert edited_pairs(documents([])).collect() == []


def test_fingerprints_keep_columns(documents):
    docs = documents([(1, "some text"), (1, "some text"), (2, None)])
    found = fingerprints(docs)
    assert found.columns == [*docs.columns, "fingerprint"]
    prints = {(r.doc_id, r.fingerprint) for r in found.collect()}
    assert prints == {(1, fingerprint("some text").tobytes().hex()), (2, fingerprint("").tobytes().hex())}
    replaced = fingerprints(docs, column="score")
    assert {(r.doc_id, r.score) for r in replaced.collect()} == prints
