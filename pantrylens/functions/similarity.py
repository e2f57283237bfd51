"""Indel similarity: 2 LCS / (|a| + |b|), in an Arrow function; rounding as exact decimal of the binary value."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over b."""
    at: dict[str, int] = {}
    for i, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    s = full
    for c in a:
        u = s & at.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(b) - s.bit_count()


def ratio(a: str, b: str) -> float:
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def words_sorted(x: str) -> str:
    return " ".join(sorted(x.split()))


def squeezed(x: str) -> str:
    return "".join(c for c in x.lower() if c.isalnum())


def weighted(a: str, b: str) -> float:
    return round(0.45 * ratio(a, b) + 0.30 * ratio(words_sorted(a), words_sorted(b)) + 0.25 * ratio(squeezed(a), squeezed(b)), 4)


@F.arrow_udf(T.DoubleType())
def weighted_similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else weighted(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


@F.arrow_udf(T.DoubleType())
def token_sort_similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    """0 to 100."""
    return pa.array([None if x is None or y is None else 100.0 if x == y else 100 * ratio(words_sorted(x), words_sorted(y)) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())
