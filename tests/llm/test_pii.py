"""PII: base patterns against the plain expressions, the tagger against held-out generated spans."""

import random
import re
import time
from collections import Counter

from pantrylens.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    double = [2 * int(c) for c in d[-2::-2]]
    return (sum(int(c) for c in d[-1::-2]) + sum(x - 9 if x > 9 else x for x in double)) % 10 == 0


def plain(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans_are_those_of_the_plain_expressions():
    rng = random.Random(8)
    pieces = ["a", "b.c", "@", "@@", ".", "-", "x@y.z", "1", "12", "255.", "256.", "0.1.2.3", "+", "+1 (2)", "4111 1111 1111 1111", " ", "é", "_", "%", "(", ")", "@a-b.c.d@e", "378282246310005", "\n"]
    for _ in range(6000):
        text = "".join(rng.choices(pieces, k=rng.randrange(1, 14)))
        assert pii.base_spans(text) == plain(text), text
    for _ in range(3000):
        text = "".join(rng.choices("0123456789.+- ()@a", k=rng.randrange(1, 40)))
        assert pii.base_spans(text) == plain(text), text


def test_base_spans_take_time_in_proportion_to_the_text():
    for unit in ("a", "1", "1.", "a@", "@", "+", "+1", "1 "):
        began = time.time()
        pii.base_spans(unit * 200_000)
        assert time.time() - began < 5, unit


def test_recall_of_added_spans():
    """Nine in ten of the spans of every kind in generated texts that the tagger has not seen, and few of what is none."""
    p, rng = pii.trained(), random.Random(99)
    found, total, wrong = Counter(), Counter(), 0
    for _ in range(400):
        text, spans = "", []
        while len(text) < 300:
            kind, s = None, pii._word(rng)
            if rng.random() < 0.12:
                kind, shape = rng.choice(pii.SHAPES)
                s = pii._fill(rng, shape).replace("\x01", "A")
            if kind:
                spans.append((kind, len(text), len(text) + len(s)))
            text += s + " "
        got = pii.added_spans([text], p)[0]
        for k, a, b in spans:
            total[k] += 1
            found[k] += any(g[0] == k and g[1] <= a + 1 and g[2] >= b - 1 for g in got)
        wrong += sum(not any(g[1] < b and a < g[2] for _, a, b in spans) for g in got)
    assert all(found[k] >= 0.9 * total[k] > 50 for k in pii.ADDED) and wrong < 0.02 * sum(total.values())
    for secret in ("password=correcthorsebattery", "password: hunter2hunter2", "ghp_" + "aBcDeFgHiJkLmNoPqRsTuVwXyZabcdefghij"):
        text = f"some words before it {secret} and some words after it"
        assert [text[a:b] for _, a, b in pii.added_spans([text], p)[0]] == [secret]
