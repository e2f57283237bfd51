"""The span index with compaction against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pantrylens.llm import bytetext, jaccard, packing, span_index, tokens


def test_outcome_after_compaction(spark, monkeypatch):
    calls, compact = [], span_index.FingerprintIndex.compact
    monkeypatch.setattr(span_index.FingerprintIndex, "compact", lambda self: (calls.append(1), compact(self))[1])
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(400)}"
    passages = [[word() for _ in range(n)] for n in (50, 60, 90)]
    rows = []
    for i in range(24):
        p = passages[i % 3]
        rows.append((i, [word() for _ in range(rng.randrange(40))] + p[rng.randrange(2) :] + [word() for _ in range(rng.randrange(40))]))
    windows = {}
    for i, w in rows:
        for p in range(len(w) - 49):
            windows.setdefault(tuple(w[p : p + 50]), i)
    want = []
    for i, w in rows:
        gone = {p + j for p in range(len(w) - 49) if windows[tuple(w[p : p + 50])] < i for j in range(50)}
        want.append((i, len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = [(r.doc_id, r.n_removed, r.kept_sha256) for r in span_index.dedup(docs, 6).collect()]
    assert calls and sorted(got) == want and sum(w[1] for w in want) > 500


def test_batches_must_ascend(spark):
    index = span_index.FingerprintIndex(spark)
    frame = lambda *ids: spark.createDataFrame([(i, 0, "a b") for i in ids], "doc_id long, tk long, text string")
    index.add(frame(5, 9))
    with pytest.raises(ValueError):
        index.add(frame(9, 12))


def test_words_that_collide_in_polynomial_hashes_are_told_apart(spark):
    """Thue-Morse words, and texts of them, are equal under any polynomial modulo a power of two."""
    bits = [i.bit_count() & 1 for i in range(1024)]
    word, other = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    tail = [f"w{i}" for i in range(60)]
    rows = [(1, f"{word} " + " ".join(tail)), (2, f"{other} " + " ".join(tail)), (3, " ".join(("x", "y")[b] for b in bits)), (4, " ".join(("y", "x")[b] for b in bits))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    windows, want = {}, {}
    for i, t in rows:
        w = t.split()
        for p in range(len(w) - 49):
            windows.setdefault(tuple(w[p : p + 50]), i)
    for i, t in rows:
        w = t.split()
        want[i] = len({p + j for p in range(len(w) - 49) if windows[tuple(w[p : p + 50])] < i for j in range(50)})
    assert want[2] == 60
    assert {r.doc_id: r.n_removed for r in span_index.dedup(docs).collect()} == want
    texts = [word, other, f"{word} {other}", f"{other} {word}"]
    tok = Tokenizer.from_file(packing.default_tokenizer())
    got = tokens.Encoder(packing.default_tokenizer()).column(pa.array(texts))
    assert [x.tolist() for x in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    h = [set(jaccard.shingles(w)[0].tolist()) for t in texts for _, _, w in bytetext.chunks(pa.array([t]))]
    assert len({frozenset(x) for x in h}) == len(texts)


def test_a_collision_of_word_hashes_changes_no_ids(monkeypatch):
    monkeypatch.setattr(bytetext.Words, "hashes", lambda self, seed=0: np.zeros(len(self.starts), np.uint64))
    text = "several different words , and a few more words\nin lines"
    tok = Tokenizer.from_file(packing.default_tokenizer())
    assert next(iter(tokens.Encoder(packing.default_tokenizer()).column(pa.array([text])))).tolist() == tok.encode(text, add_special_tokens=False).ids
