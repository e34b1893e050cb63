"""Encoding of the whole corpus with a public tokenizer (problem 8).

Byte-pair encoding in which a segment tree over the byte positions of a piece
keeps the leftmost least rank of all adjacent pairs. A merge changes the pair at
its own place and the one before it, and removes the one after it: three updates
along paths of the tree, so a piece of n bytes takes O(n log n), however long a
run without a break is.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces up to this many bytes are remembered by a worker, at most so many of them.
MEMO_BYTES, MEMO_SIZE = 48, 400_000


def default_path(name: str = VOCABULARY) -> str:
    """Where the installed public tokenizers keep a vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Byte-level BPE from a rank file; ``pattern`` splits text into pieces before the merges."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.split = regex.compile(pattern).findall
        self.memo: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """Token ids of the text as it stands; null and empty texts give an empty list."""
        out: list[int] = []
        if not text:
            return out
        memo = self.memo
        for piece in self.split(text):
            ids = memo.get(piece)
            if ids is None:
                raw = piece.encode("utf-8", "surrogatepass")
                ids = self.merge(raw)
                if len(raw) <= MEMO_BYTES:
                    if len(memo) >= MEMO_SIZE:
                        memo.clear()
                    memo[piece] = ids
            out.extend(ids)
        return out

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one piece, by merges of the leftmost pair of least rank."""
        n, ranks = len(raw), self.ranks
        if n == 1:
            return [ranks[raw]]
        size = 1 << (n - 1).bit_length()
        none = (1 << 60)
        # a leaf is rank * size + position, so that the least of two is the leftmost of least rank
        tree = [none] * (2 * size)
        get = ranks.get
        for i in range(n - 1):
            r = get(raw[i : i + 2])
            if r is not None:
                tree[size + i] = r * size + i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        end = list(range(1, n + 1))  # end of the token that starts here; also the next live position
        prev = list(range(-1, n))

        def put(at: int, value: int) -> None:
            at += size
            tree[at] = value
            at >>= 1
            while at:
                a, b = tree[2 * at], tree[2 * at + 1]
                least = a if a < b else b
                if tree[at] == least:
                    break
                tree[at] = least
                at >>= 1

        while tree[1] < none:
            i = tree[1] % size
            j = end[i]
            k = end[j]
            end[i] = k
            put(j, none)
            if k < n:
                prev[k] = i
                r = get(raw[i : end[k]])
                put(i, none if r is None else r * size + i)
            else:
                put(i, none)
            h = prev[i]
            if h >= 0:
                r = get(raw[h:k])
                put(h, none if r is None else r * size + h)
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return out


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per worker process."""
    return Encoder(path, pattern)


def token_ids(text: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """ARRAY<INT> of token ids without special tokens, whose strings in a text are ordinary text.

    Null and empty texts give an empty array. The vocabulary is read by each Python
    worker from ``path``; nothing is shuffled and texts stay whole.
    """
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    at = path or default_path()

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(at, pattern)
        for s in batches:
            yield pd.Series([enc.encode(t) for t in s])

    return ids(text)
