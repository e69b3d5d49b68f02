"""Token ids of a public BPE vocabulary, each distinct word encoded once per batch at most."""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rostrum.llm.common import expand

# Distinct words, and characters of them, that a worker remembers before it starts
# anew; bounds its memory.
CACHE_WORDS = 300_000
CACHE_CHARS = 16 << 20
# Text that is encoded at a time; more of it repeats more words.
ENCODE_BYTES = 4 << 20

# Latin letters, each with a lower case of one letter and alike under NFC.
_LATIN = r"^[A-Za-zÀ-ÖØ-öø-įı-ɏ]+$"
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed public vocabulary lies; operators take any other path."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Places(dict):
    """Word -> place in the table of encoded words; new words queue up."""

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        self.new.append(word)
        return place


class WordEncoder:
    """Ids of whole texts, equal to the tokenizer's own, from a table of encoded words.

    The vocabulary's normaliser and word pattern never look across a space or a line
    feed, so the ids of a text are those of its chunks between them, in order. A chunk
    of plain letters goes straight to the BPE model, and so does one with punctuation
    behind, which is a word of its own. Any other chunk (digits, marks within, special
    tokens, other white space) goes through the whole tokenizer. For a tokenizer of
    another kind (``words=False``) whole texts are encoded.
    """

    def __init__(self, path: str, words: bool = True, cache_words: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.whole.model)
        self.plain.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        vocabulary = self.whole.get_vocab()
        suffix = getattr(self.whole.model, "end_of_word_suffix", None)
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        if words and not suffix:
            raise ValueError("encoding by words needs a vocabulary that marks the ends of words")
        if words:
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.words = words
        self.cache_words = cache_words
        self._reset()

    def _reset(self) -> None:
        """Forget all words; place 0 is the empty word."""
        self.places = _Places({"": 0})
        self.places.new = []
        self.chars = 0
        self.ids = np.empty(1 << 16, dtype=np.int32)
        self.bounds = np.zeros(1 << 14, dtype=np.int64)

    def _learn(self) -> None:
        """Encode the words that queue up; each one ends in a token that says so."""
        new, self.places.new = self.places.new, []
        if not new:
            return
        (encoded,) = self.plain.encode_batch_fast(
            [new], is_pretokenized=True, add_special_tokens=False
        )
        ids = np.array(encoded.ids, dtype=np.int32)
        count = len(self.places)
        first = count - len(new)
        used = int(self.bounds[first])
        if used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * (used + len(ids)))
        if count >= len(self.bounds):
            self.bounds = np.resize(self.bounds, 2 * count + 1)
        self.ids[used : used + len(ids)] = ids
        self.bounds[first + 1 : count + 1] = used + 1 + np.flatnonzero(self.last[ids])
        self.chars += sum(map(len, new))

    def _chunk_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks one after another, and how many each has."""
        bodies = pc.ascii_rtrim(chunks, _PUNCTUATION)
        plain = pc.and_(pc.utf8_is_alpha(bodies), pc.string_is_ascii(bodies))
        plain = plain.to_numpy(zero_copy_only=False).copy()
        beyond = np.flatnonzero(~plain)
        latin = pc.match_substring_regex(bodies.take(pa.array(beyond)), _LATIN)
        plain[beyond] = latin.to_numpy(zero_copy_only=False)
        lowered = pc.if_else(pa.array(plain), pc.utf8_lower(bodies), "").dictionary_encode()
        words = lowered.dictionary.to_pylist()
        place = np.fromiter(map(self.places.__getitem__, words), dtype=np.int64, count=len(words))
        self._learn()
        place = place[lowered.indices.to_numpy(zero_copy_only=False)]
        starts = np.zeros((len(chunks), 2), dtype=np.int64)
        lengths = np.zeros((len(chunks), 2), dtype=np.int64)
        starts[:, 0] = self.bounds[place]
        lengths[:, 0] = self.bounds[place + 1] - starts[:, 0]
        lengths[place == 0, 0] = 0
        cut = pc.subtract(pc.binary_length(chunks), pc.binary_length(bodies)).to_numpy()
        one = np.flatnonzero(plain & (cut == 1))
        many = np.flatnonzero(plain & (cut > 1))
        odd = np.flatnonzero(~plain)
        marks = pc.utf8_slice_codeunits(chunks.take(pa.array(one)), -1).dictionary_encode()
        runs = [c[-n:] for c, n in zip(chunks.take(pa.array(many)).to_pylist(), cut[many], strict=True)]
        distinct = {tail: k for k, tail in enumerate(dict.fromkeys(marks.dictionary.to_pylist() + runs))}
        whole = [*distinct, *chunks.take(pa.array(odd)).to_pylist()]
        own = [e.ids for e in self.whole.encode_batch_fast(whole, add_special_tokens=False)]
        sizes = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
        begins = len(self.ids) + np.cumsum(sizes) - sizes
        # Marks come first among the distinct tails, in the order of their dictionary.
        which = marks.indices.to_numpy(zero_copy_only=False)
        starts[one, 1], lengths[one, 1] = begins[which], sizes[which]
        which = np.fromiter((distinct[t] for t in runs), dtype=np.int64, count=len(runs))
        starts[many, 1], lengths[many, 1] = begins[which], sizes[which]
        starts[odd, 0], lengths[odd, 0] = begins[len(distinct) :], sizes[len(distinct) :]
        more = np.fromiter(chain.from_iterable(own), dtype=np.int32, count=int(sizes.sum()))
        ids = np.concatenate((self.ids, more))[expand(starts.ravel(), lengths.ravel())]
        return ids, lengths.sum(axis=1)

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids end.

        Each text is followed by ``end_id`` if one is given. Missing and empty texts have
        no other id.
        """
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.words:
            tail = [] if end_id is None else [end_id]
            encoded = self.whole.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
            lists = [np.array(e.ids + tail, dtype=np.int32) for e in encoded]
            ends = np.cumsum([len(x) for x in lists], dtype=np.int64)
            return (np.concatenate(lists) if lists else np.empty(0, np.int32)), ends
        if len(self.places) > self.cache_words or self.chars > CACHE_CHARS:
            self._reset()
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        chunks = pc.list_flatten(lists).dictionary_encode()
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        table, lengths = self._chunk_ids(chunks.dictionary)
        place = chunks.indices.to_numpy(zero_copy_only=False)
        sizes = lengths[place]
        ids = table[expand((np.cumsum(lengths) - lengths)[place], sizes)]
        ends = np.append(0, np.cumsum(sizes))[np.cumsum(counts)]
        if end_id is not None:
            ids = np.insert(ids, ends, end_id)
            ends = ends + np.arange(1, len(ends) + 1)
        return ids, ends


@lru_cache(maxsize=2)
def encoder(path: str, words: bool) -> WordEncoder:
    """One encoder per worker process and vocabulary."""
    return WordEncoder(path, words)
