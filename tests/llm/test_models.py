"""The trained models' arithmetic against brute force."""

import itertools

import numpy as np
import pyarrow as pa

from pantrylens.llm import line_crf, toxicity
from pantrylens.llm.bytetext import IS_ALNUM, Words, buffers


def test_forward_backward_is_the_sum_over_all_labelings():
    rng = np.random.default_rng(1)
    lengths = [1, 8, 3, 5, 1, 2]
    owner = np.repeat(np.arange(len(lengths)), lengths)
    score, trans = rng.normal(0, 2, len(owner)), rng.normal(0, 1, (2, 2))

    def enumerated(score, trans):
        """Marginals, expected transitions and log Z, labeling by labeling."""
        p, pairs, logz, at = np.zeros(len(score)), np.zeros((2, 2)), 0.0, 0
        for n in lengths:
            total, mine, trip = 0.0, np.zeros(n), np.zeros((2, 2))
            for y in itertools.product((0, 1), repeat=n):
                w = np.exp(sum(score[at + i] * v for i, v in enumerate(y)) + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False)))
                total += w
                mine += w * np.array(y)
                for a, b in zip(y, y[1:], strict=False):
                    trip[a, b] += w
            p[at : at + n], pairs, logz, at = mine / total, pairs + trip / total, logz + np.log(total), at + n
        return p, pairs, logz

    got, want = line_crf.forward_backward(score, trans, owner), enumerated(score, trans)
    assert all(np.allclose(a, b) for a, b in zip(got, want, strict=True))
    # the marginals and expected transitions are the gradient of log Z
    eps = 1e-5
    for i in range(len(score)):
        step = np.where(np.arange(len(score)) == i, eps, 0)
        assert abs((enumerated(score + step, trans)[2] - enumerated(score - step, trans)[2]) / (2 * eps) - got[0][i]) < 1e-6
    for a, b in itertools.product((0, 1), repeat=2):
        step = np.zeros((2, 2))
        step[a, b] = eps
        assert abs((enumerated(score, trans + step)[2] - enumerated(score, trans - step)[2]) / (2 * eps) - got[1][a, b]) < 1e-6


def test_convolution_is_the_plain_one():
    rng = np.random.default_rng(2)
    embed = rng.normal(0, 1, (2 * toxicity.BUCKETS, toxicity.DIM))
    embed[toxicity.PAD] = 0
    filters = [rng.normal(0, 1, (w, toxicity.DIM, toxicity.FILTERS)) for w in toxicity.WIDTHS]
    k = len(filters) * toxicity.FILTERS
    model = toxicity.Model(embed, filters, rng.normal(0, 1, k), rng.normal(0, 1, k), 0.3, np.zeros(len(toxicity.LANGUAGES) + 1))
    texts = ["one", "", "some words of a text, and more", "ein Wort", "!!", "a b", None]
    buf, off = buffers(pa.array(texts))
    words = Words(buf, off, True, IS_ALNUM)
    ids = toxicity.bucketed(words)
    got = toxicity.logits(model, model.tables(), ids, words.first)
    for d in range(len(texts)):
        x = [embed[a] + embed[b] for a, b in ids[words.first[d] : words.first[d + 1]]]
        if not x:
            assert got[d] == -4
            continue
        pooled = []
        for w in filters:
            windows = [sum(np.einsum("d,df->f", x[i + j], w[j]) for j in range(len(w)) if i + j < len(x)) for i in range(len(x))]
            pooled.append(np.max(windows, 0))
        want = np.maximum(np.concatenate(pooled) + model.bias, 0) @ model.out + model.out_bias
        assert abs(got[d] - want) < 1e-3


def test_threshold_is_the_best_cut_by_trial():
    rng = np.random.default_rng(3)
    for _ in range(50):
        y = (rng.random(60) < 0.3).astype(float)
        if not 5 <= y.sum() <= 55:
            continue
        z = rng.normal(0, 1, 60) + y
        balanced = lambda cut: ((z > cut) & (y == 1)).sum() / y.sum() + ((z <= cut) & (y == 0)).sum() / (1 - y).sum()
        best = max(balanced(c) for c in z)
        assert abs(balanced(toxicity.threshold(z, y)) - best) < 1e-9
    assert toxicity.threshold(np.array([1.0, 2.0]), np.array([0.0, 1.0])) == 0


def test_the_sample_is_bounded_by_its_bytes():
    rows = [(3, 1.0, "ccc"), (1, 0.0, "a" * 6), (2, 1.0, "b" * 9), (4, 0.0, "")]
    texts, y = toxicity.bounded(rows, 10)
    assert texts == ["aaaaaa", "ccc", ""] and y.tolist() == [0, 1, 0]
