"""The tagger reads every character: against emissions and paths worked out window by window."""

import random

import numpy as np

from pantrylens.llm import pii


def weights(seed):
    rng, g4, f = np.random.default_rng(seed), 4 * pii.HIDDEN, np.float32
    p = {
        "embed": rng.normal(0, 1, (pii.CHARS, pii.EMBED)), "wf": rng.normal(0, 0.4, (pii.EMBED + pii.HIDDEN, g4)), "wb": rng.normal(0, 0.4, (pii.EMBED + pii.HIDDEN, g4)),
        "bf": rng.normal(0, 0.2, g4), "bb": rng.normal(0, 0.2, g4), "wo": rng.normal(0, 0.6, (2 * pii.HIDDEN, pii.TAGS)), "bo": np.zeros(pii.TAGS), "trans": rng.normal(0, 0.3, (pii.TAGS, pii.TAGS)),
    }
    p["bo"][0] = 2.5
    for k in range(len(pii.ADDED)):
        p["trans"][1 + 2 * k, 2 + 2 * k] += 1
        p["trans"][2 + 2 * k, 2 + 2 * k] += 1
    return {k: a.astype(f) for k, a in p.items()}


def best_path(e, trans):
    s, back = e[0].astype(float).copy(), []
    s[2::2] -= 1e4
    for x in e[1:]:
        step = s[:, None] + trans
        back.append(step.argmax(0))
        s = step.max(0) + x
    path = [int(s.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def plain_spans(text, p):
    trans = p["trans"] + pii.allowed()
    starts = [0]
    while starts[-1] + pii.READ < len(text):
        starts.append(starts[-1] + pii.READ - pii.LAP)
    deepest = [(-1, 0)] * len(text)
    for s in starts:
        tags = best_path(pii.emissions(p, pii.codes(text[s : s + pii.READ])[None])[0][:, 0], trans)
        for i, t in enumerate(tags):
            depth = min(i if s else 10**9, len(tags) - i if s + pii.READ < len(text) else 10**9)
            deepest[s + i] = max(deepest[s + i], (depth, t), key=lambda x: x[0])
    out, tags = [], [t for _, t in deepest]
    for i, t in enumerate(tags):
        if t and out and out[-1][2] == i and out[-1][0] == pii.ADDED[(t - 1) // 2] and t % 2 == 0:
            out[-1][2] = i + 1
        elif t:
            out.append([pii.ADDED[(t - 1) // 2], i, i + 1])
    outer = " \t\n\r\"'.,;:"
    cut = [(k, a + len(text[a:b]) - len(text[a:b].lstrip(outer)), b - len(text[a:b]) + len(text[a:b].rstrip(outer))) for k, a, b in out]
    return [s for s in cut if s[2] - s[1] >= pii.SHORTEST]


def test_every_window_of_plain_prose_is_read():
    """Words without a digit, an assignment or a long run: whatever the weights make of them is found, in texts of any length."""
    rng, total = random.Random(3), 0
    lengths = [1, 5, 95, 96, 97, 300, pii.READ - 1, pii.READ, pii.READ + 1, 2 * pii.READ - pii.LAP, 2 * pii.READ, 2500]
    for seed in range(3):
        p = weights(seed)
        texts = ["".join(rng.choice("abcdefgh ,.\n") for _ in range(n)) for n in lengths] + ["", "word"]
        got = pii.added_spans(texts, p)
        assert got == [plain_spans(t, p) if t else [] for t in texts]
        total += sum(map(len, got))
    assert total > 20
