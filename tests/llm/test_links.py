"""The links of the Jaccard join against brute force."""

import random
import re

from pantrylens.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_links_inside_components(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(base)), (2, " ".join(base)), (None, " ".join(base).upper()), (3, None), (4, ""), (5, "One"), (6, "one"), (7, "two words")]
    for i in range(20):
        words = list(base)
        for at in rng.sample(range(5, 195), 1 + i % 3):
            words[at] = f"e{i}"
        rows.append((10 + i // 2, " ".join(words)))  # each id twice
    rows.append(rows[-1])
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").lower())
        sets.append({tuple(w[j : j + 3]) for j in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set()))
    linked = lambda a, b: bool(a and b) and 100 * len(a & b) >= 90 * len(a | b)
    want = [(i, len(sets[k]), sum(linked(sets[k], s) for j, s in enumerate(sets) if j != k)) for k, (i, _) in enumerate(rows)]
    got = jaccard.links(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert max(w[2] for w in want) > min(w[2] for w in want if w[1] > 100)
