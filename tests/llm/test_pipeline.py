"""The stages of the pipeline against brute force."""

import corpus_pipeline as pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in texts], SCHEMA)


def test_near_copies_with_spread_edits_leave_one(spark):
    words = [f"w{i}" for i in range(200)]
    near, far = list(words), list(words)
    for i in (30, 70, 110, 150):
        near[i] = "edit"  # 176 of 216 shingles of five words: 0.815
    for i in (25, 55, 85, 115, 145, 175):
        far[i] = "other"  # 166 of 226: 0.735
    docs = frame(spark, [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))])
    assert sorted(r.doc_id for r in pipeline.keep_one_of_each(spark, docs, "").collect()) == [1, 3]


def test_one_of_each_with_repeated_and_null_ids(spark):
    base, other, third = ([f"{c}{i}" for i in range(100)] for c in "abc")
    near = lambda w: [*w[:50], "edit", *w[51:]]
    rows = [(1, base), (1, near(base)), (1, other), (2, near(other)), (2, base), (None, base), (None, third), (None, near(third)), (3, near(third)), (None, []), (2, []), (2, []), (4, other), (4, other), (None, ["alone"]), (None, ["alone"])]
    rows = [(i, " ".join(w)) for i, w in rows] + [(None, None)]
    sets = []
    for _, t in rows:
        w = (t or "").split()
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))
    for _ in rows:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    root[a] = root[b] = min(root[a], root[b])
    got = [(r.doc_id, r.text) for r in pipeline.keep_one_of_each(spark, frame(spark, rows), "").collect()]
    key = lambda i: (i is None, i or 0)
    want = {r: min(key(rows[k][0]) for k in range(len(rows)) if root[k] == r) for r in root if sets[r]}
    kept = [(root[rows.index(g)], key(g[0])) for g in got if (g[1] or "").split()]
    assert sorted(kept) == sorted(want.items())
    empty = {r for r, s in zip(rows, sets, strict=True) if not s}
    assert sorted(map(repr, (g for g in got if not (g[1] or "").split()))) == sorted(map(repr, empty))


def test_last_stages_keep_repeated_and_null_ids(spark):
    from tokenizers import Tokenizer

    rows = [(1, "mail a.b@c.de now"), (1, "call 10.0.0.1"), (None, "plain words"), (None, ""), (None, None), (1, "mail a.b@c.de now")]
    docs = frame(spark, rows)
    masked = pipeline.mask_personal_data(spark, docs, "")
    want = [(i, (t or "").replace("a.b@c.de", "[EMAIL]").replace("10.0.0.1", "[IP]")) for i, t in rows]
    assert sorted(repr((r.doc_id, r.text or "")) for r in masked.collect()) == sorted(map(repr, want))
    n = sum(len(t.split()) for _, t in want)
    assert sum(len(r.text.split()) for r in pipeline.mix_sources(spark, masked, "").collect() if r.text) == n * 3 // 2
    tok = Tokenizer.from_file(pipeline.packing.default_tokenizer())
    tokens = sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sum(p.length for p in pipeline.pack_sequences(spark, docs, "").collect()) == tokens
