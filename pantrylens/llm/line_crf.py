"""Quality classifier: a linear-chain conditional random field over lines.

Every line with a word gets features of itself and of its neighbours; the
chain labels it good or bad.  Weights are trained in numpy, in one task of the
cluster, on a bounded sample of labelled documents, whose lines take the
document's label.  A document's
quality is the length-weighted mean of the forward-backward marginals of
"good", calibrated to a probability.

Defined cases: null and empty texts have no lines and a mean of 0, which
calibrates to a low score; any number and length of lines is read; repeated
rows score alike; a null id is not held out; without labels of both classes
every score is 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import Words, buffers, spans
from .shared import fold
from .toxicity import in_one_task, sample

KINDS = {
    "symbol": np.isin(np.arange(256), list(b"#*$%&|<>")),
    "bang": np.isin(np.arange(256), list(b"!?")),
    "capital": (np.arange(256) >= 65) & (np.arange(256) <= 90),
    "digit": (np.arange(256) >= 48) & (np.arange(256) <= 57),
    "stop": np.isin(np.arange(256), list(b".,;:")),
    "letter": np.array([chr(i).isalpha() or i > 127 for i in range(256)]),
}
OWN = len(KINDS) + 6
WIDTH = 3 * OWN + 1


def line_features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, weight in bytes of words, owner) of every line with a word, in order."""
    texts = Words(buf, offsets)
    b = texts.buf
    # lines: cut at line feeds and at the ends of texts
    cuts = np.unique(np.concatenate([texts.offsets, np.flatnonzero(b == 10) + 1]))
    words = texts  # line feeds separate words, so words never cross lines
    line_of = np.searchsorted(cuts, words.starts, "right") - 1
    n_words = np.bincount(line_of, minlength=max(len(cuts), 1))
    lines = np.flatnonzero(n_words)
    if not len(lines):
        return np.zeros((0, WIDTH)), np.zeros(0), np.zeros(0, np.int64)
    starts, ends = cuts[lines], np.append(cuts, len(b))[lines + 1]
    n = n_words[lines].astype(float)
    count = lambda kind: np.diff(np.concatenate([[0], np.cumsum(kind[b])])[np.stack([starts, ends], 1)], axis=1)[:, 0].astype(float)
    h = words.hashes()
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (line_of[1:] == line_of[:-1])
    ids = np.searchsorted(lines, line_of)
    repeats = np.bincount(ids, same, len(lines)) / n
    # words of a line that it holds already, by sorted hash within the line
    order = np.lexsort((h, line_of))
    again = np.zeros(len(h))
    again[1:] = (h[order][1:] == h[order][:-1]) & (line_of[order][1:] == line_of[order][:-1])
    reused = np.bincount(ids[order], again, len(lines)) / n
    size = np.bincount(ids, words.ends - words.starts, len(lines)).astype(float)
    own = np.zeros((len(lines), OWN))
    for i, (name, kind) in enumerate(KINDS.items()):
        c = count(kind)
        own[:, i] = np.minimum(c / (n if name in ("symbol", "bang", "stop") else size), 2)
    k = len(KINDS)
    own[:, k] = np.minimum(np.log1p(n) / 5, 2)
    own[:, k + 1] = np.minimum(size / n / 10, 3)
    own[:, k + 2], own[:, k + 3] = repeats, reused * (n >= 4)
    own[:, k + 4] = np.isin(b[words.ends[np.searchsorted(line_of, lines, "right") - 1] - 1], list(b".!?"))
    own[:, k + 5] = n < 4
    owner = np.searchsorted(texts.offsets, starts, "right") - 1
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:][owner[1:] == owner[:-1]] = own[:-1][owner[1:] == owner[:-1]]
    after[:-1][owner[1:] == owner[:-1]] = own[1:][owner[1:] == owner[:-1]]
    return np.concatenate([own, before, after, np.ones((len(own), 1))], 1), size, owner


def _sequences(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each text's chain, longest first."""
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    lengths = np.diff(np.append(starts, len(owner)))
    order = np.argsort(-lengths, kind="stable")
    return starts[order], lengths[order]


def forward_backward(score: np.ndarray, trans: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of label 1, expected transition counts and log Z of all chains; chains advance side by side.

    score is the log potential of label 1 against 0 of each line.
    """
    starts, lengths = _sequences(owner)
    e = np.stack([np.zeros(len(score)), score], 1)
    alpha, beta = e.copy(), np.zeros_like(e)
    steps = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(1, steps + 1), "right")  # chains with more than t lines
    lse = lambda x, axis: np.logaddexp(x.take(0, axis), x.take(1, axis))
    for t in range(1, steps):
        at = starts[: active[t]] + t
        alpha[at] += lse(alpha[at - 1][:, :, None] + trans, 1)
    for t in range(steps - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        beta[at] = lse((e[at + 1] + beta[at + 1])[:, None, :] + trans, 2)
    logz = lse(alpha[starts + lengths - 1], 1)
    rank = np.cumsum(np.diff(owner, prepend=-1) != 0) - 1
    z = np.zeros(len(starts))
    z[rank[starts]] = logz
    per_line = z[rank]
    p = np.exp(alpha + beta - per_line[:, None])[:, 1]
    inner = np.flatnonzero(owner[1:] == owner[:-1])
    pair = alpha[inner][:, :, None] + trans + (e + beta)[inner + 1][:, None, :] - per_line[inner][:, None, None]
    return p, np.exp(pair).sum(0), float(logz.sum())


@dataclass
class Model:
    weights: np.ndarray
    trans: np.ndarray
    scale: float
    bias: float

    def means(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x, size, owner = line_features(buf, offsets)
        n = len(offsets) - 1
        if not len(x):
            return np.zeros(n)
        p, _, _ = forward_backward(x @ self.weights, self.trans, owner)
        return np.bincount(owner, p * size, n) / np.maximum(np.bincount(owner, size, n), 1)

    def scores(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.means(buf, offsets) + self.bias)))


def train(texts: list[str], labels: np.ndarray, steps: int = 150, l2: float = 1e-3) -> Model:
    """Maximum likelihood by Adam, then a logistic calibration of the document means."""
    buf, off = buffers(pa.array(texts, pa.large_string()))
    x, _, owner = line_features(buf, off)
    y = labels[owner]
    w, trans = np.zeros(WIDTH), np.zeros((2, 2))
    balance = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    m = v = np.zeros(WIDTH + 4)
    inner = np.flatnonzero(owner[1:] == owner[:-1])
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner].astype(int), y[inner + 1].astype(int)), 1)
    for t in range(1, steps + 1):
        p, pairs, _ = forward_backward(x @ w, trans, owner)
        g = np.concatenate([x.T @ ((p - y) * balance) + l2 * w, (pairs - seen).ravel() / max(1, len(inner)) / 4 + l2 * trans.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, trans = w - step[:WIDTH], trans - step[WIDTH:].reshape(2, 2)
    model = Model(w, trans, 1.0, 0.0)
    q = model.means(buf, off)
    a, c = 6.0, -3.0
    for t in range(400):  # plain gradient steps on two parameters, classes weighted alike
        s = 1 / (1 + np.exp(-(a * q + c)))
        d = (s - labels) * np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))
        a, c = a - 4 * (d @ q), c - 4 * d.sum()
    return Model(w, trans, float(max(a, 1e-3)), float(c))


def scorer(model: Model | None):
    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        out = np.zeros(len(text))
        if model is not None:
            buf, offsets = buffers(text)
            for a, b in spans(offsets):
                out[a:b] = model.scores(buf, offsets[a : b + 1])
        return pa.array(out)

    return score


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = in_one_task(sample(docs, labels, "quality", 3, 1), train)
    x = docs.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), scorer(model)(F.col("text")).alias("score"))
    return x.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
