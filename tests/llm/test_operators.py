"""The corpus operators against brute force on a small table with nulls, empties, copies and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pantrylens.llm import html_text, jaccard, line_crf, media, mixing, packing, pii, rules, span_index, toxicity, webp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, key string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def make(seed=1):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdeéß", k=rng.randrange(1, 8))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, passage = text(200), text(60)
    near = base.split()
    near[100] = "CHANGED"
    texts = [base, base, " ".join(near), text(80) + "\n" + passage + "\t" + text(30), passage + " " + text(20), None, "", "  \n ", "One", "two Words", "ONE", text(3000), passage, text(49), (text(10) + "\n") * 6]
    rows = [(i, t, "en", [None, "a", "b"][i % 3], len(t or ""), 7, "x") for i, t in enumerate(texts)]
    return rows + [rows[0], rows[4]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    frames = [html_text.extract(pages), media.round_trip(empty), mixing.mix(empty), span_index.dedup(empty), jaccard.join(empty), line_crf.predict(empty, labels), rules.quality_rules(empty), toxicity.predict(empty, labels), packing.pack(empty), pii.find(empty), mixing.mixed(empty), pii.redact(empty)]
    assert [f.count() for f in frames] == [0] * len(frames)


def test_span_index(docs):
    rows = make()
    windows = {}
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        for p in range(len(w) - 49):
            k = tuple(w[p : p + 50])
            windows[k] = min(i, windows.get(k, i))
    want = []
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        gone = {p + j for p in range(len(w) - 49) if windows[tuple(w[p : p + 50])] < i for j in range(50)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    for batches in (1, 3):
        got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in span_index.dedup(docs, batches).collect()]
        assert sorted(got) == sorted(want)


def test_jaccard_join(docs):
    rows = make()
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + 3]) for j in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = sorted((i, len(sets[i]), find(i)) for i, *_ in rows)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()) == want
    assert {find(0), find(1), find(2)} == {0} and find(8) == find(10)


def test_signatures_meet_for_every_linked_pair():
    rng = np.random.default_rng(3)
    bands = jaccard.Bands(90)
    for n in (1, 5, 10, 11, 19, 20, 40, 100, 300):
        a = np.unique(rng.integers(1, 1 << 63, n).astype(np.uint64))
        for _ in range(30):
            drop = rng.integers(0, max(1, n // 19 + 1))
            b = np.unique(np.concatenate([a[drop:], rng.integers(1, 1 << 63, drop).astype(np.uint64)]))
            both, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            if 100 * both >= 90 * union:
                s = [set(jaccard.signatures(x, np.zeros(len(x), np.int64), np.array([len(x)]), bands)[0].tolist()) for x in (a, b)]
                assert s[0] & s[1]


def test_mix(docs):
    rows = mixing.mix(docs).collect()
    total = sum(r["size"] for r in rows)
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    for part in by.values():
        assert sum(r.taken for r in part) == int(part[0].target) and part[0].source_size == sum(r["size"] for r in part)
    assert abs(sum(p[0].target for p in by.values()) - 1.5 * total) < 1e-6
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    words = sum(len(WORD.findall(r.text or "")) for r in mixing.mixed(docs).collect())
    assert words == sum(r.taken for r in rows)


def test_rules(docs):
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rules.quality_rules(docs).collect())
    want = []
    for i, t, *_ in make():
        t = t or ""
        w = WORD.findall(t)
        tri = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        often = Counter(tri)
        cover = {j + k for j, g in enumerate(tri) if often[g] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)))
    assert got == sorted(want)


def test_packing(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    pieces = packing.pack(docs).collect()
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for i, t, *_ in make()}
    for p in pieces:
        own = np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4")
        assert len(own) == p.length and zlib.crc32(own.tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids[p.doc_id])
    assert sum(p.length for p in pieces) == sum(len(ids[i]) for i, *_ in make())
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024 and at & (at - 1) == 0


def test_webp_transforms():
    rng = np.random.default_rng(5)
    for shape in ((1, 1), (3, 70), (20, 11)):
        for image in (rng.integers(0, 256, (*shape, 4)), rng.integers(0, 3, (*shape, 4)) * 40, np.full((*shape, 4), 9)):
            image = image.astype(np.uint8)
            for transforms in ((), (webp.PREDICTOR,), (webp.CROSS,), (webp.GREEN,), (webp.PREDICTOR, webp.CROSS, webp.GREEN)):
                for mode in range(14) if transforms == (webp.PREDICTOR,) else (13,):
                    for cache in (0, 4):
                        f = webp.encode(image, transforms, cache, True, 2, mode)
                        assert (webp.decode_many([f])[0] == image).all()


def test_webp_predictors_of_many_images():
    rng = np.random.default_rng(6)
    for width in (1, 2, 7, 64):
        for bits in (2, 4):
            heights = [1, 2, 5, 33, 33, 8]
            parts = [rng.integers(0, 1 << 32, (h, width)).astype(np.uint32) for h in heights]
            side = lambda n, bits=bits: (n + (1 << bits) - 1) >> bits
            modes = [(rng.integers(0, 5, (side(h), side(width))) << 8).astype(np.uint32) for h in heights]
            got = webp.undo_predictors(parts, bits, modes)
            assert all((x == webp.undo_predictor(p, bits, m)).all() for x, p, m in zip(got, parts, modes, strict=True))


def test_webp_fitted_transforms():
    rng = np.random.default_rng(7)
    y, x = np.mgrid[0:40, 0:50]
    grey = rng.integers(0, 256, (40, 50))
    drift = np.stack([grey, grey, grey, np.full_like(grey, 255)], -1)
    slope = np.stack([3 * x, 3 * x + y // 16, 5 * x, np.full_like(x, 255)], -1)
    used = []
    for image in (drift, slope, rng.integers(0, 256, (40, 50, 4)), rng.integers(0, 256, (1, 1, 4)), rng.integers(0, 256, (9, 64, 4))):
        image = image.astype(np.uint8)
        f = webp.encode(image, None, palette=False, bits=4)
        assert (webp.decode_many([f])[0] == image).all()
        kinds = {t[0]: t[3] for t in webp.Image(f).transforms}
        assert set(kinds) == {webp.PREDICTOR, webp.CROSS}
        used.append((bool((kinds[webp.PREDICTOR] & 0xF00).any()), bool((kinds[webp.CROSS] & 0xFFFFFF).any())))
    assert used[0][1] and used[1][0]
    few = np.repeat(rng.integers(0, 256, (1, 2, 4)), 9, 0).astype(np.uint8)
    f = webp.encode(few, None)
    assert [t[0] for t in webp.Image(f).transforms] == [webp.PALETTE] and (webp.decode_many([f])[0] == few).all()


def test_webp_rejects_broken_files():
    f = webp.encode(np.random.default_rng(1).integers(0, 256, (9, 9, 4)).astype(np.uint8))
    with pytest.raises(ValueError):
        webp.decode_many([b"x" + f[1:]])
    with pytest.raises(ValueError):
        webp.decode_many([f[:40]])


def test_media(docs):
    for r, (i, t, *_) in zip(sorted(media.round_trip(docs).collect(), key=lambda r: r.doc_id), sorted(make(), key=lambda r: r[0]), strict=True):
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


def test_html():
    page = "<title>t</title><nav><a href=1>Home</a></nav><article><h1>A &amp; B</h1><p>one\n two<p>three <b>four</b></article><div class='comments'><p>I liked it</div><footer>f</footer><script>'<p>'</script>"
    assert html_text.main_text(page) == "A & B\none two\nthree four"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p") == ""


def test_pii(docs):
    t = "mail a.b@c.de, 10.0.0.1, 4111 1111 1111 1111, +1 (555) 123-4567 or 999.1.1.1"
    assert pii.base_spans(t) == [("email", 5, 13), ("ip", 15, 23), ("card", 25, 44), ("phone", 46, 63)]
    p = pii.trained()
    assert pii.masked(t, pii.all_spans([t], p)[0][1]).startswith("mail [EMAIL], [IP], [CARD], [PHONE] or")
    key = "the word and a AKIA" + "Q7XJ2M5NPL3RST9V" + " in the text of this line and more words here to read"
    assert any(s[0] == "secret" for s in pii.all_spans([key], p)[0][1])
    long = "plain words only " * 400 + key + " plain words" * 400
    assert pii.all_spans([long], p)[0][1] and not pii.all_spans(["plain words only " * 40], p)[0][1]
    assert pii.find(docs).count() == len(make())


def test_classifiers(spark):
    rng = random.Random(2)
    vocab = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(200)]
    rows, marks = [], []
    for i in range(600):
        words = [rng.choice(vocab) for _ in range(60)]
        toxic, bad = i % 4 == 0, i % 3 == 0
        if toxic:
            words[rng.randrange(60)] = "vileword"
        text = "\n".join(" ".join(words[j : j + 20]) + "." for j in (0, 20, 40))
        rows.append((i, " | ".join(text.split()) if bad else text, "en", "a", 0, 0, ""))
        marks.append((i, int(not bad), int(toxic)))
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    for got, truth in ((toxicity.predict(docs, labels), {m[0]: m[2] for m in marks}), (line_crf.predict(docs, labels), {m[0]: m[1] for m in marks})):
        held = [r for r in got.collect() if r.held_out]
        assert len(held) > 50 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
        assert all(0 <= r.score <= 1 for r in held)
