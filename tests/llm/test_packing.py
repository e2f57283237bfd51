"""Mixture-controlled packing against a serial deficit round-robin."""

import random

import pytest

from pantrylens.llm import packing


def serial(queues, window):
    """Windows as lists of (queue, tokens): shares of the queues that can still take a turn, deficits carried as fractions."""
    left, out = [t for t, _ in queues], []
    active = [q for q, (t, w) in enumerate(queues) if t and w]
    while active:
        total, k, got = sum(queues[q][1] for q in active), 0, dict.fromkeys(active, 0)
        while True:
            upto, take = 0, {}
            for q in active:
                before = upto * window * (k + 1) // total
                upto += queues[q][1]
                take[q] = upto * window * (k + 1) // total - before - got[q]
            over = [q for q in active if take[q] > left[q]]
            if over:
                break
            out.append([(q, take[q]) for q in active])
            for q in active:
                got[q] += take[q]
                left[q] -= take[q]
            k += 1
        active = [q for q in active if q not in over]
    return out, left


@pytest.mark.parametrize("queues", [[(5000, 5000), (3000, 3000), (777, 777)], [(5000, 1), (300, 3), (9000, 2), (40, 0)], [(7, 1), (2048, 1)], [(1, 1)], [(0, 0), (10, 0)], []])
def test_schedule_is_the_serial_one(queues):
    window, rng = 64, random.Random(3)
    plan = packing.Schedule(queues, window)
    want, left = serial(queues, window)
    filled = {}
    for q, (n, _) in enumerate(queues):
        a = 0
        while a < n:  # documents of any size
            b = min(n, a + rng.randrange(1, 150))
            at = a
            for start, length, sequence, offset in plan.pieces(q, a, b):
                assert start == at and length > 0
                at += length
                filled.setdefault(sequence, []).append((offset, length, q))
            assert at == b
            a = b
    assert plan.windows == len(want)
    for s, parts in filled.items():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at == window or s >= len(want) and at & (at - 1) == 0
    for s, shares in enumerate(want):
        assert [(q, sum(n for _, n, own in filled[s] if own == q)) for q, _ in shares] == shares
    assert sum(sum(n for _, n, _ in p) for s, p in filled.items() if s >= len(want)) == sum(left)


def test_every_window_holds_the_target_shares(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["some", "words", "of", "text"], k=rng.randrange(1, 900))), [None, "a", "b", "b", "c"][i % 5]) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    source = {i: s for i, _, s in rows}
    for targets in (None, {"a": 2, "b": 1, None: 1}):
        pieces = packing.pack(docs, targets=targets).collect()
        tokens = {s: sum(p.length for p in pieces if source[p.doc_id] == s) for s in set(source.values())}
        weight = tokens if targets is None else {**{"c": 0}, **targets}
        queues = sorted(((w, s is None, s or "") for s, w in weight.items() if w))
        full, _ = serial([(tokens[None if null else s], w) for w, null, s in queues], 1024)
        assert len(full) > 15
        held = {}
        for p in pieces:
            held.setdefault(p.sequence_id, {}).setdefault(source[p.doc_id], []).append(p.length)
        for k, shares in enumerate(full):
            assert {s: sum(n) for s, n in held[k].items()} == {None if queues[q][1] else queues[q][2]: n for q, n in shares if n}
        share = {s: w / sum(weight.values()) for s, w in weight.items()}
        assert all(abs(sum(held[0].get(s, [0])) - 1024 * share[s]) < 1 for s in share)


def test_small_sources_share_a_queue(spark):
    rows = [(i, "word " * (400 if i % 2 else 3), "big" if i % 2 else f"small{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = packing.pack(docs).collect()
    assert sum(p.length for p in pieces ) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())
    totals = docs.selectExpr("source is null as s0", "source as s1", "cast(1 as bigint) as n").groupBy("s0", "s1").sum("n").withColumnRenamed("sum(n)", "n")
    own, queues = packing.queues_of(totals, None)
    assert len(own) <= packing.GRAIN and len(queues) == len(own) + 2
