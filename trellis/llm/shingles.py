"""Normal form, character shingles and minhash values of texts, in numpy batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRAM = 4
_U64 = np.uint64


def normal_form(text: Column) -> Column:
    """Lower case; letters and digits kept, every other run becomes one space; trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the splitmix64 finaliser)."""
    x = x.astype(_U64, copy=True)
    x ^= x >> _U64(30)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


def grams(norm: str | None) -> np.ndarray:
    """Sorted distinct 64-bit values of the 4-character substrings; empty below four characters."""
    if norm is None or len(norm) < GRAM:
        return np.empty(0, _U64)
    c = np.frombuffer(norm.encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U64)
    n = len(c) - GRAM + 1
    lo = c[:n] | (c[1 : n + 1] << _U64(21)) | (c[2 : n + 2] << _U64(42))
    return np.unique(mix64(lo + mix64(c[3 : n + 3] + _U64(0x9E3779B97F4A7C15))))


def similarity(a: str | None, b: str | None) -> float:
    """Intersection over union of the shingle sets; 0 where both are empty."""
    x, y = grams(a), grams(b)
    if not len(x) or not len(y):
        return 0.0
    both = np.intersect1d(x, y, assume_unique=True).size
    return both / (len(x) + len(y) - both)


@F.pandas_udf(T.DoubleType())
def similarity_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x, y) for x, y in zip(a, b)], dtype=float)


class MinHash:
    """``n`` minhash values of 32 bits per shingle set."""

    def __init__(self, n: int, seed: int):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 2**32, n, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 2**32, n, dtype=np.uint32)

    def __call__(self, g: np.ndarray) -> np.ndarray:
        """The shingles are scrambled words already, so 32 bits of each under an affine map will do."""
        least = np.full(len(self.a), np.iinfo(np.uint32).max, np.uint32)
        for at in range(0, len(g), 2048):  # long texts in blocks
            h = (g[at : at + 2048] >> _U64(32)).astype(np.uint32)[:, None] * self.a
            h += self.b
            np.minimum(least, h.min(axis=0), out=least)
        return least


def one_bits(values: np.ndarray) -> np.ndarray:
    """One well-mixed bit of each minhash value; equal values give equal bits."""
    return (mix64(values.astype(_U64)) & _U64(1)).astype(np.uint8)


def words_of_bits(bits: np.ndarray) -> list[int]:
    """Bits as signed 64-bit words, the last one filled with zeros."""
    return [int(x) for x in np.packbits(np.pad(bits, (0, -len(bits) % 64))).view(np.int64)]
