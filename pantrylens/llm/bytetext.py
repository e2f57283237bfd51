"""Vectorised access to the words of a text column.

Arrow hands a string column over as one UTF-8 buffer with offsets, so words
(runs of bytes other than 0x20 and 0x09-0x0D) can be found, hashed and counted
for thousands of texts with a few numpy passes and without Python strings.
Nulls count as empty texts throughout.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once; a single longer text is handled alone.
CHUNK_BYTES = 1 << 21

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
IS_INK = ~IS_SPACE
#: Letters, digits and anything beyond ASCII.
IS_ALNUM = np.array([chr(i).isalnum() or i > 127 for i in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser (public splitmix64 constants)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


#: Bytes of a word that are mixed in blocks of eight; longer words are hashed by a cryptographic function.
BLOCKS = 8


def _blocks(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as one value."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf),), "<u8", padded, 0, (1,))


def _block(view: np.ndarray, starts: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Block at each start, with bytes beyond the `left` ones cleared."""
    short = np.minimum(left, 8).astype(U64)
    return view[starts] & (U64(0xFFFFFFFFFFFFFFFF) >> ((U64(8) - short) * U64(8)))


def byte_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges (none empty): each block of eight bytes is mixed into the state of those before.

    Ranges of one length up to eight bytes never collide; different seeds give independent hashes.
    """
    n = ends - starts
    h = mix64(n.astype(U64) * U64(0x9E3779B97F4A7C15) + seeded(1, 1000 + seed)[0])
    if not len(n):
        return h
    view = _blocks(buf)
    act = np.arange(len(n))
    for k in range(BLOCKS):
        h[act] = mix64(h[act] ^ _block(view, starts[act] + 8 * k, n[act] - 8 * k))
        act = act[n[act] > 8 * (k + 1)]
        if not len(act):
            break
    key = bytes([seed])
    for i in act.tolist():
        h[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8, key=key).digest(), "little")
    return h


def same_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether buf[a:a+n] equals buf[b:b+n], for every triple."""
    same = np.ones(len(n), bool)
    view = _blocks(buf)
    act = np.flatnonzero(n > 0)
    for k in range(BLOCKS):
        same[act] &= _block(view, a[act] + 8 * k, n[act] - 8 * k) == _block(view, b[act] + 8 * k, n[act] - 8 * k)
        act = act[n[act] > 8 * (k + 1)]
        if not len(act):
            break
    for i in act.tolist():
        same[i] &= bool((buf[a[i] : a[i] + n[i]] == buf[b[i] : b[i] + n[i]]).all())
    return same


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two sequences one after the other; not symmetric, not linear."""
    return mix64(mix64(a + U64(0xD1B54A32D192ED03)) * U64(0x2545F4914F6CDD1D) + b)


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] (none empty): the two longest stretches of a power of two that cover it, and its length."""
    n = ends - starts
    out = np.zeros(len(n), U64)
    if not len(n):
        return out
    k = np.frexp(n.astype(float))[1] - 1
    level, size = values, 1
    for step in range(int(k.max()) + 1):
        at = np.flatnonzero(k == step)
        if len(at):
            out[at] = mix64(joined(level[starts[at]], level[ends[at] - size]) + n[at].astype(U64))
        if step < k.max():
            longer = level.copy()
            longer[:-size] = joined(level[:-size], level[size:])
            level, size = longer, 2 * size
    return out


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n+1 offsets; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, offsets.astype(np.int64)


def spans(offsets: np.ndarray, limit: int = 0) -> Iterator[tuple[int, int]]:
    """Row ranges of about CHUNK_BYTES bytes."""
    limit, a, n = limit or CHUNK_BYTES, 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b
        a = b


class Words:
    """The words of some texts: byte ranges, owner of each, hashes on demand."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, lower: bool = False, inside: np.ndarray = IS_INK) -> None:
        base = int(offsets[0])
        self.buf = buf[base : int(offsets[-1])]
        if lower:
            self.buf = LOWER[self.buf]
        self.offsets = offsets - base
        n = len(self.buf)
        ink = inside[self.buf]
        starts = ink.copy()
        starts[1:] &= ~ink[:-1]
        firsts = self.offsets[:-1][self.offsets[:-1] < self.offsets[1:]]
        starts[firsts] = ink[firsts]
        ends = ink.copy()
        ends[:-1] &= ~ink[1:]
        ends[firsts[1:] - 1] = ink[firsts[1:] - 1]
        if n:
            ends[n - 1] = ink[n - 1]
        self.starts, self.ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        #: words of text d are first[d]:first[d+1]
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return byte_hashes(self.buf, self.starts, self.ends, seed)


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[start:start+size] of every range, joined."""
    upto = np.cumsum(sizes) - sizes
    return values[np.arange(int(sizes.sum())) + np.repeat(starts - upto, sizes)]


def chunks(col: pa.Array, lower: bool = False, inside: np.ndarray = IS_INK) -> Iterator[tuple[int, int, Words]]:
    """Row range and words, a few MB at a time."""
    buf, offsets = buffers(col)
    for a, b in spans(offsets):
        yield a, b, Words(buf, offsets[a : b + 1], lower, inside)


def sort_within(owner: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Order by owner, then value (owner is already ascending)."""
    order = np.argsort(values, kind="stable")
    return order[np.argsort(owner[order], kind="stable")]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
