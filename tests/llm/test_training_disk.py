"""What training moves between tasks: its rows once, as embedding rows, and never a text."""

import random

import numpy as np
import pytest

from pantrylens.llm import toxicity


@pytest.fixture()
def shuffled(spark):
    """A function: the bytes that stages have written for others since its last call."""
    gateway, store, before = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore(), [0]

    def written() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        total = sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))
        before[0], out = total, total - before[0]
        return out

    written()
    return written


@pytest.fixture()
def corpus(spark, tmp_path):
    """A function: n documents of so many random words, as read from a file, and labels of the first `marked`."""

    def make(n: int, words: int, marked: int):
        rng = random.Random(3)
        vocabulary = ["".join(rng.choices("abcdefghij", k=9)) for _ in range(200)]
        docs = [(i, " ".join(rng.choices(vocabulary, k=words) + (["vile"] if i % 2 else []))) for i in range(n)]
        spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
        return spark.read.parquet(str(tmp_path / "docs")), spark.createDataFrame([(i, i % 2) for i in range(marked)], "doc_id long, toxic int")

    return make


def test_passes_do_not_move_the_rows_again(corpus, shuffled):
    docs, labels = corpus(1500, 500, 1500)
    shuffled()
    assert toxicity.fit(docs, labels) is not None
    assert 0 < shuffled() < 4 * 500 * 1500  # four bytes a word


def test_many_labels_move_no_text(spark, corpus, shuffled, monkeypatch):
    docs, labels = corpus(3000, 500, 60)
    monkeypatch.setattr(toxicity, "BROADCAST_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    shuffled()
    try:
        assert toxicity.fit(docs, labels) is not None
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffled() < 2e6  # the texts come to 15 MB


def test_many_labels_find_the_same_rows(spark, monkeypatch):
    docs = [(i % 900, f"word{i} and more") for i in range(1000)] + [(None, "no id"), (5, None), (7, "")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, [0, 1, 2, None][i % 4]) for i in range(600)] + [(8, 1), (None, 1), (5000, 1)], "doc_id int, toxic int")
    rows = lambda: sorted(map(tuple, toxicity.labelled(docs, labels, "toxic", 5, 0).select("o", "y", "lang", "n", "ids").collect()))
    want = rows()
    monkeypatch.setattr(toxicity, "BROADCAST_ROWS", 0)
    assert rows() == want and len(want) > 200
    monkeypatch.setattr(toxicity, "BITS", toxicity.BLOCK_BITS)  # more ids share a bit
    assert rows() == want


def test_lanes_give_the_mean_of_all_groups(spark, corpus, monkeypatch):
    docs, labels = corpus(300, 20, 300)
    monkeypatch.setattr(toxicity, "GROUP_ROWS", 25)
    monkeypatch.setattr(toxicity, "EPOCHS", 2)
    models = []
    for lanes, per_lane in ((1, 100), (3, 4), (100, 1)):
        monkeypatch.setattr(toxicity, "LANES", lanes)
        monkeypatch.setattr(toxicity, "LANE_GROUPS", per_lane)
        models.append(toxicity.fit(docs, labels))
    for m in models[:2]:
        for a, b in ((m.embed, models[2].embed), (m.out, models[2].out), *zip(m.filters, models[2].filters, strict=True)):
            assert np.allclose(a, b, atol=1e-5)
    assert not spark.catalog.listTables()
