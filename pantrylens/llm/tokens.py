"""Token ids of whole texts, by a public byte-level BPE vocabulary.

Texts are cut into white space and words with their leading space; within a
chunk every distinct word (found by hash, compared by its bytes) is encoded
once, and ids are gathered from there.
Where that cut could differ from the tokenizer's own (white space beyond ASCII,
special tokens in a text) the text is encoded as a whole.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .bytetext import U64, Words, buffers, gathered, same_bytes, spans

#: The pre-tokenizer of byte-level BPE (public pattern, fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: First bytes of white space beyond ASCII, of control characters that some take for it, and of special tokens.
LEADS = np.isin(np.arange(256), [0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, ord("<")])
#: Bytes of text encoded at once.
CHUNK = 1 << 21


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: itself, or the next one from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@functools.cache
def encoding(path: str):
    """The encoder of a tokenizers JSON file and the byte length of every id."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    chars = byte_of_char()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(chars[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    enc = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    sizes = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
    sizes[list(ranks.values())] = [len(b) for b in ranks]
    return enc, sizes


def odd_texts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts that may hold what the cut into words treats differently from the tokenizer."""
    at = np.flatnonzero(LEADS[buf])
    b = buf[at]
    c = buf[np.minimum(at + 1, len(buf) - 1)] if len(buf) else b
    d = buf[np.minimum(at + 2, len(buf) - 1)] if len(buf) else b
    hit = (b < 0x20) | ((b == ord("<")) & (c == ord("|"))) | ((b == 0xC2) & ((c == 0x85) | (c == 0xA0))) | ((b == 0xE1) & ((c == 0x9A) | (c == 0xA0)))
    hit |= ((b == 0xE2) & (((c == 0x80) & ((d <= 0x8A) | (d >= 0xA8))) | (c == 0x81))) | ((b == 0xE3) & (c == 0x80))
    return np.unique(np.searchsorted(offsets, at[hit] + offsets[0], "right") - 1)


class Encoder:
    def __init__(self, path: str) -> None:
        self.enc, self.sizes = encoding(path)
        self.gaps: dict[tuple[bytes, bool], list[int]] = {}

    def _gap(self, s: bytes, split_last: bool) -> list[int]:
        """White space before a word that keeps no space of it (its last character stands alone), or elsewhere."""
        key = (s, split_last)
        if key not in self.gaps:
            if len(self.gaps) > 100_000:
                self.gaps.clear()
            t = s.decode()
            self.gaps[key] = self.enc.encode_ordinary(t[:-1]) + self.enc.encode_ordinary(t[-1:]) if split_last else self.enc.encode_ordinary(t)
        return self.gaps[key]

    def _distinct(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, spaced: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each with one space or line feed before it, and where each word's ids end."""
        sizes = ends - starts + 1
        joined = gathered(buf, starts - 1, sizes)  # the byte before is overwritten
        joined[np.cumsum(sizes) - sizes] = np.where(spaced, 32, 10)
        ids = np.array(self.enc.encode_ordinary(joined.tobytes().decode("utf-8")), np.int64)
        return ids, np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(sizes), "left") + 1

    def chunk(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts and the number in each."""
        w = Words(buf, offsets)
        b, n = w.buf.tobytes(), len(w.counts)
        s, e, own = w.starts, w.ends, w.owner()
        begin = w.offsets[:-1][own]
        spaced = (s > begin) & (w.buf[np.maximum(s - 1, 0)] == 32)
        key = w.hashes() * U64(2) + spaced.astype(U64)
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        size = e - s
        if not ((size == size[first][which]) & same_bytes(w.buf, s, s[first][which], np.minimum(size, size[first][which]))).all():
            # two words of one hash: tell the words apart by themselves
            seen: dict[tuple[bytes, bool], int] = {}
            which = np.array([seen.setdefault((b[x:y], bool(z)), len(seen)) for x, y, z in zip(s.tolist(), e.tolist(), spaced.tolist(), strict=True)])
            first = np.unique(which, return_index=True)[1]
        none = np.zeros(0, np.int64)
        ids, ends = self._distinct(w.buf, s[first], e[first], spaced[first]) if len(first) else (none, none)
        lead = np.concatenate([[0], ends[:-1]]) + ~spaced[first] if len(ends) else ends  # the line feed is not the word's
        # white space before each word, less the space it keeps, and after the last word of a text
        prev = np.maximum(np.concatenate([[0], e[:-1]]), begin) if len(s) else s
        gap = (s - spaced) - prev
        g = np.flatnonzero(gap > 0)
        pieces = [(prev[i], own[i], self._gap(b[prev[i] : s[i] - spaced[i]], not spaced[i])) for i in g.tolist()]
        lasts = np.where(w.counts > 0, e[np.maximum(w.first[1:] - 1, 0)] if len(e) else 0, w.offsets[:-1])
        for d in np.flatnonzero(lasts < w.offsets[1:]).tolist():
            pieces.append((lasts[d], d, self._gap(b[lasts[d] : w.offsets[d + 1]], False)))
        extra = np.array([x for _, _, ids_ in pieces for x in ids_], np.int64)
        size_x = np.array([len(x) for _, _, x in pieces], np.int64)
        start_x = len(ids) + np.cumsum(size_x) - size_x
        at = np.concatenate([s - spaced, np.array([p for p, _, _ in pieces], np.int64)]).astype(np.int64)
        size = np.concatenate([(ends - lead)[which] if len(ends) else ends, size_x])
        src = np.concatenate([lead[which] if len(ends) else ends, start_x])
        owner = np.concatenate([own, np.array([d for _, d, _ in pieces], np.int64)]).astype(np.int64)
        order = np.argsort(at, kind="stable")
        size, src, owner = size[order], src[order], owner[order]
        return gathered(np.concatenate([ids, extra]), src, size), np.bincount(owner, size, n).astype(np.int64)

    def column(self, text: pa.Array) -> Iterator[np.ndarray]:
        """The ids of every text of a column, in order; nulls count as empty."""
        buf, offsets = buffers(text)
        for a, z in spans(offsets, CHUNK):
            ids, counts = self.chunk(buf, offsets[a : z + 1])
            part = np.split(ids, np.cumsum(counts)[:-1])
            for d in odd_texts(buf[offsets[a] : offsets[z]], offsets[a : z + 1]).tolist():
                own = buf[offsets[a + d] : offsets[a + d + 1]].tobytes()
                part[d] = np.array(self.enc.encode(own.decode(), allowed_special="all"), np.int64)
            yield from part
