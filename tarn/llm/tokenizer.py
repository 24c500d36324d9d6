"""Byte-pair encoding of whole texts with a public rank file.

A word of the pre-split pattern is merged over a contiguous rank array: part boundaries and the rank of each
adjacent pair are held side by side, the minimum is looked for again and again, its inner boundary deleted and the
two neighbouring ranks refreshed.  Words beyond ``SHORT`` bytes, where repeated scanning would be quadratic, go
through a heap over linked parts with the same order of merges (lowest rank, then leftmost), so the ids are equal.

The rank file is read once on the driver, checked to be at most ``MAX_FILE`` bytes and broadcast.

Defined results: null and empty texts have no ids (an empty list); the strings of special tokens are ordinary
text; every byte has a token, so any text can be encoded.
"""

from __future__ import annotations

import base64
import heapq
import os
from array import array
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the public vocabularies lie, unless a caller or TARN_TOKENIZERS says otherwise.
TOKENIZER_DIR = os.environ.get("TARN_TOKENIZERS", "/opt/tokenizers")
RANKS = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHORT = 160
MAX_FILE = 64 << 20
CACHE_WORDS = 200_000
_NEVER = 1 << 60


class Encoder:
    """Encodes texts with the ranks of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks = ranks
        self.words = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}

    @classmethod
    def from_file(cls, blob: bytes) -> Encoder:
        """From the bytes of a rank file: base64 token and rank on each line."""
        return cls({base64.b64decode(t): int(r) for t, r in (line.split() for line in blob.splitlines() if line)})

    def merge_short(self, word: bytes) -> list[int]:
        rank = self.ranks.get
        if (whole := rank(word)) is not None:
            return [whole]
        cuts = list(range(len(word) + 1))
        pairs = [rank(word[i : i + 2], _NEVER) for i in range(len(word) - 1)]
        while pairs and (low := min(pairs)) < _NEVER:
            i = pairs.index(low)
            del cuts[i + 1], pairs[i]
            if i:
                pairs[i - 1] = rank(word[cuts[i - 1] : cuts[i + 1]], _NEVER)
            if i < len(pairs):
                pairs[i] = rank(word[cuts[i] : cuts[i + 2]], _NEVER)
        return [self.ranks[word[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]

    def merge_long(self, word: bytes) -> list[int]:
        rank, n = self.ranks.get, len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, mid, end = heapq.heappop(heap)
            if not alive[i] or after[i] != mid or mid >= n or after[mid] != end:
                continue
            alive[mid] = False
            after[i] = end
            if end < n:
                before[end] = i
                if (r := rank(word[i : after[end]])) is not None:
                    heapq.heappush(heap, (r, i, end, after[end]))
            if (p := before[i]) >= 0 and (r := rank(word[p:end])) is not None:
                heapq.heappush(heap, (r, p, i, end))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[word[i : after[i]]])
            i = after[i]
        return out

    def word(self, word: str) -> tuple[int, ...]:
        raw = word.encode()
        ids = tuple(self.merge_short(raw) if len(raw) <= SHORT else self.merge_long(raw))
        if len(word) <= 40:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            self.known[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        get, word = self.known.get, self.word
        for w in self.words(text or ""):
            out += get(w) or word(w)
        return out

    def count(self, text: str | None) -> int:
        get, word = self.known.get, self.word
        return sum(len(get(w) or word(w)) for w in self.words(text or ""))


@lru_cache(maxsize=4)
def encoder(blob: bytes) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    return Encoder.from_file(blob)


def read_ranks(path: str | None = None) -> bytes:
    path = path or os.path.join(TOKENIZER_DIR, RANKS)
    size = os.path.getsize(path)
    if size > MAX_FILE:
        raise ValueError(f"{path} has {size} bytes; a vocabulary may have {MAX_FILE}")
    with open(path, "rb") as f:
        return f.read()


def ids(spark: SparkSession, text: Column, path: str | None = None) -> Column:
    """The token ids of ``text`` as array<int>."""
    blob = spark.sparkContext.broadcast(read_ranks(path))

    @F.arrow_udf(T.ArrayType(T.IntegerType(), False))
    def encode(texts: pa.Array) -> pa.Array:
        enc, flat, ends = encoder(blob.value), array("i"), array("i", [0])
        for t in texts:
            flat.extend(enc.encode(t.as_py()))
            ends.append(len(flat))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))

    return encode(text)


def n_tokens(spark: SparkSession, text: Column, path: str | None = None) -> Column:
    """How many tokens ``text`` has; 0 for null."""
    blob = spark.sparkContext.broadcast(read_ranks(path))

    @F.arrow_udf(T.LongType())
    def count(texts: pa.Array) -> pa.Array:
        enc = encoder(blob.value)
        return pa.array([enc.count(t.as_py()) for t in texts], pa.int64())

    return count(text)
