"""The toxicity model learns from every labelled row outside the held-out fold."""

import numpy as np
from pyspark.sql import functions as F

from pantrylens.llm import toxicity


def test_words_of_late_rows_are_learned(spark):
    """The last toxic rows by the hash of the id share a word that no earlier row has; more rows come before them than a sample of 1500 of 3000 ids took."""
    ids = spark.range(4500).filter("crc32(cast(cast(id as string) as binary)) % 5 <> 0").orderBy(F.xxhash64(F.lit("toxic"), "id"), "id")
    toxic = [r.id for r in ids.collect()]
    assert len(toxic) > 3400
    rows = [(i, f"plain words here {'alpha' if k < 3000 else 'omega'} and more of them", 1) for k, i in enumerate(toxic)]
    rows += [(10_000 + i, "plain words here gamma and more of them", 0) for i in range(1200)]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(-1, "omega of them"), (-2, "gamma of them"), (-3, "alpha of them")], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.predict(docs, labels).filter("doc_id < 0").collect()}
    assert got == {-1: 1, -2: 0, -3: 1}


def test_counts_are_of_all_rows(spark):
    rows = [(i, ["aa bb aa", "bb", "", "cc aa"][i % 4], float(i % 2)) for i in range(3000)]
    enc = toxicity.encoded(spark.createDataFrame(rows, "o long, text string, y double").repartition(5))
    per = toxicity.text_counts(enc)
    want = np.zeros_like(per)
    for text in ("aa bb aa", "bb", "", "cc aa"):
        from pantrylens.llm.bytetext import IS_ALNUM, Words

        b = text.encode()
        seen = np.unique(toxicity.bucketed(Words(np.frombuffer(b, np.uint8), np.array([0, len(b)]), True, IS_ALNUM))) if b else []
        for at in seen:
            want[int(text in ("bb", "cc aa"))][at] += 750
    assert (per == want).all() and per.sum() > 0


def test_threshold_counts_repeats():
    rng = np.random.default_rng(5)
    for _ in range(50):
        z, y = rng.integers(-9, 9, 80) / 4, (rng.random(80) < 0.4).astype(int)
        cells, n = np.unique(np.stack([z * 4, y]).astype(int), axis=1, return_counts=True)
        cut = toxicity.threshold(cells[0] / 4, cells[1], n)
        assert cut == toxicity.threshold(z, y)
        balanced = lambda c: ((z > c) & (y == 1)).sum() / y.sum() + ((z <= c) & (y == 0)).sum() / (1 - y).sum()  # noqa: B023,E731
        assert abs(balanced(cut) - max(balanced(c) for c in z if c < z.max())) < 1e-9
