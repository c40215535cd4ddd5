"""Problem 8: encoding of texts into the ids of a public tokenizer.

Method: a text is split into words by the tokenizer's pattern; a word that is no token itself is held as a
contiguous array of parts with the rank of each adjacent pair; the smallest rank is scanned for,
its boundary deleted and the two neighbouring ranks refreshed, until no pair has a rank. Words are
short, so a scan beats a heap; a run of one class that is very long (a line of dashes, a text
without blanks) goes through a heap over a linked list, which gives the same ids in n log n.

Words recur, so each worker process keeps the ids of the words met before (bounded). Texts pass through Arrow
batches without a shuffle; the vocabulary file is read once per process from a path that every
executor must see.

Defined results: null and empty texts give an empty list; special tokens are never produced, their strings are
ordinary text; lone surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

#: Fixed value: the split pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = os.environ.get("PILEGRAIN_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
NONE = 1 << 40
LONG_WORD = 200
KEPT_WORDS = 400_000


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) > LONG_WORD:
        return _merge_long(word, ranks)
    get = ranks.get
    cut = list(range(len(word) + 1))
    rank = [get(word[i : i + 2], NONE) for i in range(len(word) - 1)]
    while rank:
        low = min(rank)
        if low == NONE:
            break
        i = rank.index(low)
        del cut[i + 1], rank[i]
        if i < len(rank):
            rank[i] = get(word[cut[i] : cut[i + 2]], NONE)
        if i:
            rank[i - 1] = get(word[cut[i - 1] : cut[i + 1]], NONE)
    return [ranks[word[a:b]] for a, b in zip(cut, cut[1:])]  # noqa: B905, RUF007


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n, get = len(word), ranks.get
    ahead, back = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = ahead[i]
        if not alive[i] or j >= n or ahead[j] != end:
            continue
        alive[j] = False
        ahead[i] = end
        if end < n:
            back[end] = i
            if (r := get(word[i : ahead[end]])) is not None:
                heapq.heappush(heap, (r, i, ahead[end]))
        if (p := back[i]) >= 0 and (r := get(word[p:end])) is not None:
            heapq.heappush(heap, (r, p, end))
    return [ranks[word[i : ahead[i]]] for i in range(n) if alive[i]]


@lru_cache(maxsize=4)
def vocabulary_of(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a vocabulary file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[str], list[int]]:
    """The encoding function of a vocabulary file; one per process."""
    import regex

    ranks = vocabulary_of(path)
    find = regex.compile(PATTERN).findall
    known: dict[str, list[int]] = {}

    def encode(text: str) -> list[int]:
        out: list[int] = []
        for word in find(text):
            ids = known.get(word)
            if ids is None:
                ids = merge_word(word.encode("utf-8"), ranks)
                if len(word) <= 40:
                    if len(known) >= KEPT_WORDS:
                        known.clear()
                    known[word] = ids
            out += ids
        return out

    return encode


def token_ids(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Array of ids; empty for null and empty texts."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def ids(texts: pa.Array) -> pa.Array:
        encode = encoder(vocabulary)
        return pa.array([encode(t) if t else [] for t in texts.to_pylist()], pa.list_(pa.int32()))

    return ids(text)


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Number of ids; 0 for null and empty texts. Only the count leaves the worker."""

    @F.arrow_udf(LongType())
    def count(texts: pa.Array) -> pa.Array:
        encode = encoder(vocabulary)
        return pa.array([len(encode(t)) if t else 0 for t in texts.to_pylist()], pa.int64())

    return count(text)


def decoded(ids: Column, vocabulary: str = VOCABULARY) -> Column:
    """The text of an array of ids; null stays null, no ids give an empty text."""

    @F.arrow_udf("string")
    def text(lists: pa.Array) -> pa.Array:
        pieces = {i: t for t, i in vocabulary_of(vocabulary).items()}
        return pa.array([None if x is None else b"".join(pieces[i] for i in x).decode("utf-8", "replace") for x in lists.to_pylist()], pa.string())

    return text(ids)
