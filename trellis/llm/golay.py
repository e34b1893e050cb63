"""Fuzzy keys of 23-bit words by the perfect binary Golay code."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

N, K = 23, 12
GENERATOR = 0b101011100011  # x^11+x^9+x^7+x^6+x^5+x+1


def _remainder(v: int) -> int:
    for i in range(N - 1, N - K - 1, -1):
        if v >> i & 1:
            v ^= GENERATOR << (i - (N - K))
    return v


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the bytes of a word, and for each syndrome the error patterns of weight up to 4.

    Every word lies within distance 3 of one codeword. If the distance is 3, five
    more codewords lie at distance 4; else none do. Two words that differ in at
    most two bits have a word within one bit of both, so the lists of codewords
    within distance 4 of each have one in common.
    """
    syn = np.zeros((3, 256), np.int32)
    for part in range(3):
        for b in range(256):
            v = b << 8 * part
            syn[part, b] = _remainder(v & (1 << N) - 1)
    patterns = np.full((1 << N - K, 6), -1, np.int32)
    counts = np.zeros(1 << N - K, np.int32)
    for w in range(5):
        for pos in combinations(range(N), w):
            e = sum(1 << p for p in pos)
            s = _remainder(e)
            patterns[s, counts[s]] = e
            counts[s] += 1
    return syn, patterns, counts


def near_codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (12 bits) of all codewords within distance 4 of each word, and which of the six slots hold one."""
    syn, patterns, _ = tables()
    w = words.astype(np.int32)
    s = syn[0][w & 255] ^ syn[1][w >> 8 & 255] ^ syn[2][w >> 16 & 255]
    e = patterns[s]
    return (w[..., None] ^ np.maximum(e, 0)) >> (N - K), e >= 0
