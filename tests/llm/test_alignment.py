"""Token alignment against whole texts encoded plainly and all pairs of byte ranges."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rostrum.llm.alignment import BYTES_VOCABULARY, PIECES_VOCABULARY, align, group_ends
from rostrum.llm.common import table
from rostrum.llm.tokens import vocabulary_path

ODD = [
    "a  b\n c <s> \t <|endoftext|> x",
    " lead and trail  ",
    "\n\n\n",
    " ",
    "naïve façade — “quoted” … été",
    "日本語 テキスト and 😀😀 emoji‍ x",
    "don't can't we'll 3.14 1,000 x=1;",
    "a b c　d e",
    "word \n word\t\tword \r\n word",
    "▁ ▁▁ x▁y ▁z",
    "<0x41> <unk> </s>",
    "é ö combining",
    "\x00\x01 control \x7f",
    "x" * 400 + " " + "y" * 300,
]


def brute(rows):
    """Every row's result from whole texts, tokens as byte ranges."""
    first = Tokenizer.from_file(vocabulary_path(BYTES_VOCABULARY))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(PIECES_VOCABULARY))
    spelled = {}
    code = 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            spelled[chr(b)] = b
        else:
            spelled[chr(256 + code)] = b
            code += 1
    done, count = [], Counter()
    for _, text in rows:
        a, b = [], []
        if text:
            a = [(i, bytes(spelled[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
            for i in second.encode(text):
                piece = second.id_to_piece(i)
                b.append((i, bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()))
            wanted = b" " + text.encode()
            if b"".join(x for _, x in a) != wanted or b"".join(x for _, x in b) != wanted:
                a, b = [], []
        spans = []
        for side in (a, b):
            ends = np.cumsum([len(x) for _, x in side], dtype=int).tolist()
            spans.append([(i, e - len(x), e) for (i, x), e in zip(side, ends)])
        links = [(i, j) for i, s, e in spans[0] for j, t, f in spans[1] if s < f and t < e]
        cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups, start = [], 0
        for cut in cuts:
            sides = (",".join(str(i) for i, s, e in side if start <= s and e <= cut) for side in spans)
            groups.append("|".join(sides))
            start = cut
        done.append((len(a), len(b), groups, links))
        count.update(set(links))
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    out = []
    for (key, _), (n_a, n_b, groups, links) in zip(rows, done):
        shown = hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else ""
        n_best = sum(count[p] == best[p[0]] for p in links)
        out.append((key, n_a, n_b, len(groups), len(links), n_best, sum(count[p] for p in links), shown))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("sizes", [(6 << 20, 64 << 20), (300, 500)])
def test_equals_whole_texts(documents, sizes):
    rng = random.Random(4)
    words = "the of stone réseau über don't Ungeheuer 42 x, 日本 ,. antidisestablishment".split()
    rows = [(i, t) for i, t in enumerate(ODD)]
    rows += [(100 + i, "".join(w + rng.choice([" ", " ", " ", "  ", "\n"]) for w in rng.choices(words, k=40))) for i in range(30)]
    rows += [(None, "no key at all"), (7, None), (7, ""), rows[3], rows[20], rows[20]]
    result = align(documents(rows), block_bytes=sizes[0], bucket_bytes=sizes[1])
    assert result.columns == [
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    ]
    assert found(result) == brute(rows)


def test_equals_whole_texts_of_a_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").limit(40)
    rows = [(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 4000]
    assert found(align(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_pointers_reach_the_last_token_of_a_long_group():
    """Two tokenizations that never end together but at the very end."""
    n = 5000
    a_ends, b_ends = 2 * np.arange(1, n + 1), np.append(2 * np.arange(n) + 1, 2 * n)
    a_label, b_label, first, last = group_ends(a_ends, b_ends)
    assert set(a_label) == set(b_label) == {n}
    assert (last - first).min() >= 1


def test_empty_table_and_no_texts(documents):
    assert align(documents([])).collect() == []
    assert found(align(documents([(1, None), (2, "")]))) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
