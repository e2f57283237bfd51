"""PII: base patterns plus a character-level bidirectional LSTM with CRF transitions.

The base kinds (email, ip, card, phone) are matched by pattern over the whole
text, in time linear in it.  A BiLSTM-CRF, trained in numpy from labelled spans
that a generator writes into pseudo-text, tags every character of every text
and adds spans of further forms and of secrets.  Long texts are read in
overlapping windows; a character takes the tag of the window in which it lies
deepest, so spans are reconciled over the whole text.  What it tags is reported
as it is, less outer punctuation, from SHORTEST characters on.

Defined cases: null and empty texts have no spans; texts of any length are
read whole, in windows; added spans that touch a base span are dropped; offsets
count code points; repeated rows give equal rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LOCAL = string.ascii_letters + string.digits + "._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match that fails from the start of a run of digits fails from within it, too.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: Code points of the shortest span that is added.
SHORTEST = 6


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`: outward from every @, so that long runs without one cost nothing."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = free + len(text[free:at].rstrip(LOCAL))
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            out.append((begin, m.end()))
        free = m.end() if begin < at and m else at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches of each kind in the order of KINDS; failing ones are dropped without another try."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# --- the tagger ------------------------------------------------------------------

#: Kinds that the model may add; tags are O, then B and I of each.
ADDED = ("phone", "secret", "account")
TAGS = 1 + 2 * len(ADDED)
WINDOW, EMBED, HIDDEN, CHARS = 96, 12, 20, 130
#: Characters of a window that is read, and of two of them that overlap; windows that are read side by side.
READ, LAP, ROWS = 768, 96, 256


def codes(text: str) -> np.ndarray:
    """ASCII as it is; 128 for other letters, 129 for the rest, 0 for padding."""
    x = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.where(x < 128, np.maximum(x, 1), 128)


@functools.cache
def allowed() -> np.ndarray:
    """Transitions that a tag sequence may make: I follows B or I of its kind only."""
    ok = np.zeros((TAGS, TAGS))
    for k in range(len(ADDED)):
        ok[:, 2 + 2 * k] = -1e4
        ok[1 + 2 * k, 2 + 2 * k] = ok[2 + 2 * k, 2 + 2 * k] = 0
    return ok


#: Letters of pseudo-words, frequent ones repeated.
LETTERS = "eeeeetttaaaaoooiiiinnnsssrrrhhhddllluuuccmmffwyppvbggkkqzzjxäöüßéèñóçíáúêà"
SETS = {"9": "0123456789", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "h": "0123456789abcdef", "w": LETTERS, "c": string.ascii_letters, "m": string.ascii_letters + string.digits}


def _word(rng: random.Random) -> str:
    return "".join(rng.choices(LETTERS, k=rng.randrange(1, 12)))


def _fill(rng: random.Random, shape: str) -> str:
    """9: digit, A: capital or digit, h: hex digit, w: small letter, c: letter, m: letter or digit, where the letters stand in runs; the rest stands for itself."""
    return "".join(rng.choice(SETS[c]) if c in SETS and _placeholder(shape, i) else c for i, c in enumerate(shape))


def _placeholder(shape: str, i: int) -> bool:
    """Digits always; letters in runs of three or more of one letter, so that words in shapes stay."""
    c, a, b = shape[i], i, i
    while a > 0 and shape[a - 1] == c:
        a -= 1
    while b + 1 < len(shape) and shape[b + 1] == c:
        b += 1
    return c == "9" or b - a >= 2 or (c in "wh" and shape.startswith("sk-")) or (c == "w" and "9" in shape and i > 3)


#: Shapes of labelled spans by kind, and shapes that are none (kind None).
SHAPES = (
    ("phone", "(999) 999-9999"), ("phone", "999-999-9999"), ("phone", "999-999-9999"), ("phone", "999.999.9999"), ("phone", "09999 999999"), ("phone", "01 99 99 99 99"),
    ("secret", "\x01KIAAAAAAAAAAAAAAAAA"), ("secret", "hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh"), ("secret", "password=hhhhhhhhhhhhhhhhhh"), ("secret", "pwd=wwww9999ww"), ("secret", "sk-wwww99ww9w9w9w9w99wwww9w9w"),
    ("secret", "password=wwwwwwwwwwww"), ("secret", "password: wwwwww99"), ("secret", "password: wwwwwwwwwwwwww"), ("secret", "secret=wwww99wwww"), ("secret", "api_key=mmmmmmmmmmmmmmmmmmmmmmmm"), ("secret", "token: mmmmmmmmmmmmmmmmmmmm"),
    ("secret", "ghp_mmmmmmmmmmmmmmmmmmmmmmmmmmmmmmmmmmmm"), ("secret", "ghp_cccccccccccccccccccccccccccccccccccc"), ("secret", "mmmmmmmmmmmmmmmmmmmmmmmmmmmmmmmm"),
    ("account", "999-99-9999"), ("account", "999-99-9999"), ("account", "999-99-9999"),  # easily taken for a phone number: shown more often
    ("account", "DE99 9999 9999 9999 9999 99"), ("account", "FR9999999999999999999999999"),
    (None, "version 9.9"), (None, "9.9."), (None, "9999"), (None, "99.99.9999"), (None, "9999-99-99"), (None, "9,999"), (None, "99%"), (None, "9.99"), (None, "99"), (None, "9999999"), (None, "99:99"), (None, "$99.99"),
    (None, "wwwwwwwwwwwwwwwwwwwwwwwwwww"), (None, "wwww=wwww"), (None, "wwww: wwwwww"), (None, "https://www.wwwwwww.com/wwwww/wwwwww"), (None, "wwwwwww-wwwwww-wwwwwwwww"), (None, "the password wwwww"), (None, "a token of wwwww"), (None, "secret wwww"),
    (None, "www.wwwwwwwwww.org/wwww-9999"), (None, "|wwww|99|wwww|"), (None, "===================="), (None, "--------------------"), (None, "wwwww_wwwww_wwwwwwwww_www"), (None, "Passage 99"), (None, "passwwwww"), (None, "wwwwww###"), (None, "wwwww!!"), (None, "wwwww!! www!!"), (None, "*** wwwww"), (None, "999 wwww 99"), (None, "99.9.99"),
    (None, "+9 (999) 999-9999"), (None, "99.999.99.99"), (None, "9999999999999999"), (None, "wwww.99@wwww9.example.com"),
)


def labelled(n: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """n windows of pseudo-text with generated spans: character codes and tags."""
    rng = random.Random(seed)
    x, y = np.zeros((n, WINDOW), np.int64), np.zeros((n, WINDOW), np.int64)
    for i in range(n):
        text, tags = "", []
        loud = rng.random() < 0.15
        while len(text) < WINDOW + 40:
            kind, s = None, _word(rng)
            if loud:
                s = s.upper() + rng.choice(("", "", "!!", "###", ","))
            if rng.random() < 0.3:
                kind, shape = rng.choice(SHAPES)
                s = _fill(rng, shape).replace("\x01", "A")
            quote = kind == "secret" and rng.random() < 0.3
            lead = '"' if quote else ""
            tail = ('"' if quote else "") + (rng.choice(".,;") if rng.random() < 0.15 else "") + ("\n" if rng.random() < 0.03 else " ")
            k = 1 + 2 * ADDED.index(kind) if kind else 0
            tags += [0] * len(lead) + ([k] + [k + 1] * (len(s) - 1) if k else [0] * len(s)) + [0] * len(tail)
            text += lead + s + tail
        cut = rng.randrange(40)
        x[i], t = codes(text[cut : cut + WINDOW]), np.array(tags[cut : cut + WINDOW])
        if t[0] and t[0] % 2 == 0:  # a span cut off by the window's start begins there
            t[0] -= 1
        y[i] = t
    return x, y


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def lstm(x: np.ndarray, w: np.ndarray, b: np.ndarray, keep: bool = False):
    """Hidden states of a batch (time, rows, features) -> (time, rows, HIDDEN)."""
    steps, rows, _ = x.shape
    h, c = np.zeros((rows, HIDDEN), x.dtype), np.zeros((rows, HIDDEN), x.dtype)
    out, kept = np.zeros((steps, rows, HIDDEN), x.dtype), []
    for t in range(steps):
        xin = np.concatenate([x[t], h], 1)
        g = xin @ w + b
        i, f, o = sigmoid(g[:, :HIDDEN]), sigmoid(g[:, HIDDEN : 2 * HIDDEN]), sigmoid(g[:, 2 * HIDDEN : 3 * HIDDEN])
        u = np.tanh(g[:, 3 * HIDDEN :])
        before = c
        c = f * c + i * u
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        if keep:
            kept.append((xin, i, f, o, u, before, tc))
    return out, kept


def lstm_back(dout: np.ndarray, w: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of inputs, weights and bias."""
    dw, db = np.zeros_like(w), np.zeros(w.shape[1], w.dtype)
    rows = dout.shape[1]
    dx = np.zeros((len(kept), rows, w.shape[0] - HIDDEN), w.dtype)
    dh, dc = np.zeros((rows, HIDDEN), w.dtype), np.zeros((rows, HIDDEN), w.dtype)
    for t in range(len(kept) - 1, -1, -1):
        xin, i, f, o, u, before, tc = kept[t]
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - tc * tc)
        g = np.concatenate([dc * u * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)], 1)
        dw += xin.T @ g
        db += g.sum(0)
        d = g @ w.T
        dx[t], dh = d[:, :-HIDDEN], d[:, -HIDDEN:]
        dc = dc * f
    return dx, dw, db


def emissions(p: dict, x: np.ndarray, keep: bool = False):
    e = p["embed"][x.T]  # time, rows, features
    a, ka = lstm(e, p["wf"], p["bf"], keep)
    b, kb = lstm(e[::-1], p["wb"], p["bb"], keep)
    h = np.concatenate([a, b[::-1]], 2)
    return h @ p["wo"] + p["bo"], h, ka, kb


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.log(np.exp(x - m).sum(axis)) + m.squeeze(axis)


def crf_gradient(e: np.ndarray, trans: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log-likelihood of a batch and its gradients by emissions and transitions."""
    steps, rows, _ = e.shape
    a, b = e.copy(), np.zeros_like(e)
    for t in range(1, steps):
        a[t] += _lse(a[t - 1][:, :, None] + trans, 1)
    for t in range(steps - 2, -1, -1):
        b[t] = _lse((e[t + 1] + b[t + 1])[:, None, :] + trans, 2)
    z = _lse(a[-1], 1)
    de = np.exp(a + b - z[:, None])
    dt = np.zeros_like(trans)
    for t in range(steps - 1):
        dt += np.exp(a[t][:, :, None] + trans + (e[t + 1] + b[t + 1])[:, None, :] - z[:, None, None]).sum(0)
    r = np.arange(rows)
    gold = e[0][r, y[:, 0]].sum()
    for t in range(steps):
        de[t][r, y[:, t]] -= 1
        if t:
            gold += (e[t][r, y[:, t]] + trans[y[:, t - 1], y[:, t]]).sum()
            np.add.at(dt, (y[:, t - 1], y[:, t]), -1)
    return (z.sum() - gold) / rows, de / rows, dt / rows


@functools.cache
def trained(windows: int = 8000, epochs: int = 8, seed: int = 11) -> dict:
    """The tagger, from generated labelled spans only; the same on every driver."""
    rng = np.random.default_rng(seed)
    x, y = labelled(windows)
    g4 = 4 * HIDDEN
    p = {
        "embed": rng.normal(0, 0.3, (CHARS, EMBED)), "wf": rng.normal(0, 0.2, (EMBED + HIDDEN, g4)), "wb": rng.normal(0, 0.2, (EMBED + HIDDEN, g4)),
        "bf": np.zeros(g4), "bb": np.zeros(g4), "wo": rng.normal(0, 0.2, (2 * HIDDEN, TAGS)), "bo": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS)),
    }
    p = {k: a.astype(np.float32) for k, a in p.items()}
    p["bo"][0] = 2.0
    for b in ("bf", "bb"):
        p[b][HIDDEN : 2 * HIDDEN] = 1.0
    m, v, t = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    order = np.arange(windows)
    for epoch in range(epochs):
        rng.shuffle(order)
        for part in np.array_split(order, windows // 100):
            e, h, ka, kb = emissions(p, x[part], True)
            _, de, dt = crf_gradient(e, p["trans"] + allowed().astype(np.float32), y[part])
            de = de.astype(np.float32)
            g = {"wo": np.einsum("trh,trk->hk", h, de), "bo": de.sum((0, 1)), "trans": dt}
            dh = de @ p["wo"].T
            dxf, g["wf"], g["bf"] = lstm_back(dh[:, :, :HIDDEN], p["wf"], ka)
            dxb, g["wb"], g["bb"] = lstm_back(dh[::-1, :, HIDDEN:], p["wb"], kb)
            g["embed"] = np.zeros_like(p["embed"])
            np.add.at(g["embed"], x[part].T, dxf + dxb[::-1])
            t += 1
            rate = 0.02 * (1 - epoch / epochs)
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return p


def viterbi(e: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best tags (steps, rows) of windows, the longest first, from emissions (steps, TAGS, rows)."""
    steps, _, rows = e.shape
    active = np.searchsorted(-lengths, -np.arange(steps), "left")  # windows with more than t characters
    back = np.zeros(e.shape, np.int8)
    s = e[0].copy()
    s[2::2] -= 1e4
    for t in range(1, steps):
        n = active[t]
        x = s[:, None, :n] + trans[:, :, None]
        back[t, :, :n] = x.argmax(0)
        s[:, :n] = x.max(0) + e[t, :, :n]
    out = np.zeros((steps, rows), np.int8)
    last = s.argmax(0)
    for t in range(steps - 1, -1, -1):
        n, m = active[t], active[t + 1] if t + 1 < steps else 0
        out[t, m:n] = last[m:n]
        if m:
            out[t, :m] = back[t + 1][out[t + 1, :m], np.arange(m)]
    return out


def read(x: np.ndarray, lengths: np.ndarray, p: dict) -> np.ndarray:
    """Emissions (steps, TAGS, rows) of the codes (steps, rows) of windows, the longest first: those of emissions(), a step of all windows at once and nothing kept."""
    steps, rows = x.shape
    active = np.searchsorted(-lengths, -np.arange(steps), "left")
    out = np.zeros((steps, TAGS, rows), np.float32)
    half = np.concatenate([np.full(3 * HIDDEN, 0.5, np.float32), np.ones(HIDDEN, np.float32)])[:, None]  # a sigmoid is a tanh of half its argument
    for w, b, wo, times in ((p["wf"], p["bf"], p["wo"][:HIDDEN], range(steps)), (p["wb"], p["bb"], p["wo"][HIDDEN:], range(steps - 1, -1, -1))):
        inner, table = np.ascontiguousarray(w[EMBED:].T * half), np.ascontiguousarray(p["embed"].T)
        outer = np.ascontiguousarray(np.concatenate([w[:EMBED], b[None]]).T * half)
        both, wo = np.concatenate([outer, inner], 1), np.ascontiguousarray(wo.T)
        z, c = np.zeros((EMBED + 1 + HIDDEN, rows), np.float32), np.zeros((HIDDEN, rows), np.float32)
        z[EMBED] = 1
        g, tc = np.zeros((4 * HIDDEN, rows), np.float32), np.zeros((HIDDEN, rows), np.float32)
        for t in times:
            n = int(active[t])
            if n < g.shape[1] and times.step > 0:  # windows that have ended
                z, c, g, tc = (np.ascontiguousarray(v[:, :n]) for v in (z, c, g, tc))
            elif times.step < 0 and n != g.shape[1]:  # windows that begin at their last character
                grow = lambda v, n=n: np.concatenate([v, np.zeros((len(v), n - v.shape[1]), np.float32)], 1) if v.shape[1] < n else np.ascontiguousarray(v[:, :n])
                z, c, g, tc = (grow(v) for v in (z, c, g, tc))
                z[EMBED] = 1
            z[:EMBED] = np.take(table, x[t, :n], axis=1)
            np.matmul(both, z, out=g)
            np.tanh(g, out=g)
            gates, u, h = g[: 3 * HIDDEN], g[3 * HIDDEN :], z[EMBED + 1 :]
            gates *= 0.5
            gates += 0.5
            u *= g[:HIDDEN]
            c *= g[HIDDEN : 2 * HIDDEN]
            c += u
            np.tanh(c, out=tc)
            np.multiply(g[2 * HIDDEN : 3 * HIDDEN], tc, out=h)
            out[t, :, :n] += wo @ h
    out += p["bo"][:, None]
    return out


def unsure(e: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Characters (steps, rows) that the best path may give a tag other than O.

    A stretch of other tags is on the best path only if its emissions and
    transitions, the best ones there are, outweigh those of O in its place; a
    character in no such stretch is O.
    """
    t = trans - trans[0, 0]
    within, enter, leave = float(t[1:, 1:].max()), float(t[0, 1::2].max()), float(t[1:, 0].max())
    q = e[:, 1:].max(1) - e[:, 0] + within
    last = np.arange(q.shape[1])
    q[0] += max(0.0, -enter)  # a stretch at an end of the window has no such transition
    q[lengths - 1, last] += max(0.0, -leave)
    q[np.arange(len(e))[:, None] >= lengths] = -1e9
    ahead, behind = q.copy(), q.copy()  # largest sums of stretches that end and begin here
    for i in range(1, len(q)):
        ahead[i] += np.maximum(ahead[i - 1], 0)
        behind[-1 - i] += np.maximum(behind[-i], 0)
    return ahead + behind - q + (enter + leave - within) > -0.01


def tagged(windows: list[np.ndarray], p: dict) -> list[np.ndarray | None]:
    """Tags of each window of codes, None if all are O: the best path, decoded in the stretches that are not sure to be O.

    Of these, stretches too short for a span stay O, unless they touch the place
    where the next window takes over.
    """
    trans = p["trans"] + allowed().astype(np.float32)
    order = sorted(range(len(windows)), key=lambda i: -len(windows[i]))
    out: list[np.ndarray | None] = [None] * len(windows)
    todo: list[tuple[int, int, np.ndarray]] = []

    def decode() -> None:
        todo.sort(key=lambda x: -len(x[2]))
        for a in range(0, len(todo), ROWS):
            some = todo[a : a + ROWS]
            lengths = np.array([len(x) for _, _, x in some])
            e = np.zeros((lengths[0], TAGS, len(some)), np.float32)
            for r, (_, _, x) in enumerate(some):
                e[: len(x), :, r] = x
            tags = viterbi(e, lengths, trans)
            for r, (i, at, x) in enumerate(some):
                if tags[: len(x), r].any():
                    if out[i] is None:
                        out[i] = np.zeros(len(windows[i]), np.int8)
                    out[i][at : at + len(x)] |= tags[: len(x), r]
        todo.clear()

    for a in range(0, len(order), ROWS):
        part = order[a : a + ROWS]
        lengths = np.array([len(windows[i]) for i in part])
        x = np.zeros((len(part), int(lengths[0])), np.uint8)
        for r, i in enumerate(part):
            x[r, : lengths[r]] = windows[i]
        e = read(np.ascontiguousarray(x.T), lengths, p)
        edges = np.diff(np.pad(unsure(e, lengths, trans).T.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        (rows, begins), ends = np.nonzero(edges > 0), np.nonzero(edges < 0)[1]
        over = (begins <= LAP // 2) & (ends >= LAP // 2) | (begins <= READ - LAP // 2) & (ends >= READ - LAP // 2)
        kept = over | (ends - begins >= SHORTEST)
        for r, i, j in zip(rows[kept].tolist(), begins[kept].tolist(), ends[kept].tolist(), strict=True):
            low, high = max(i - 1, 0), min(j + 1, int(lengths[r]))
            piece = e[low:high, :, r].copy()
            piece[: i - low, 1:] -= 1e4  # the neighbours are O
            piece[j - low :, 1:] -= 1e4
            todo.append((part[r], low, piece))
        if len(todo) >= 4 * ROWS:
            decode()
    if todo:
        decode()
    return out


def window_starts(n: int) -> range:
    """Starts of the windows that cover a text of n characters; the last one reaches further than LAP."""
    return range(0, max(1, n - LAP), READ - LAP)


def reconciled(text: str, starts: range, tags: list[np.ndarray | None]) -> list[tuple[str, int, int]]:
    """Spans of a text: each character's tag is that of the window in which it lies deepest."""
    tag = np.zeros(len(text), np.int8)
    for k, (s, row) in enumerate(zip(starts, tags, strict=True)):
        if row is not None:
            low = s + LAP // 2 if k else 0  # of the characters that two windows share, each has half
            high = s + READ - LAP // 2 if k + 1 < len(starts) else len(text)
            tag[low:high] = row[low - s : high - s]
    out: list[list] = []
    for i in np.flatnonzero(tag).tolist():
        kind, begin = ADDED[(int(tag[i]) - 1) // 2], tag[i] % 2 == 1
        if out and out[-1][2] == i and out[-1][0] == kind and not begin:
            out[-1][2] = i + 1
        else:
            out.append([kind, i, i + 1])
    spans = []
    for kind, a, b in out:
        while a < b and text[a] in " \t\n\r\"'.,;:":
            a += 1
        while b > a and text[b - 1] in " \t\n\r\"'.,;:":
            b -= 1
        if b - a >= SHORTEST:
            spans.append((kind, a, b))
    return spans


def added_spans(texts: list[str], p: dict) -> list[list[tuple[str, int, int]]]:
    """What the tagger finds in each text; windows of all texts go through it together."""
    jobs = [(i, s) for i, t in enumerate(texts) if t for s in window_starts(len(t))]
    tags = tagged([codes(texts[i][s : s + READ]).astype(np.uint8) for i, s in jobs], p)
    found: list[list] = [[] for _ in texts]
    at = 0
    for i, t in enumerate(texts):
        starts = window_starts(len(t)) if t else range(0)
        own = tags[at : at + len(starts)]
        at += len(starts)
        if any(x is not None for x in own):
            found[i] = reconciled(t, starts, own)
    return found


def all_spans(texts: list[str], p: dict) -> list[tuple[list, list]]:
    """(base, base and added) of each text, the latter by kind, then start."""
    order = {k: i for i, k in enumerate((*KINDS, *[k for k in ADDED if k not in KINDS]))}
    out = []
    for base, more in zip([base_spans(t) for t in texts], added_spans(texts, p), strict=True):
        extra = [s for s in more if not any(s[1] < b[2] and b[1] < s[2] for b in base)]
        out.append((base, sorted(base + extra, key=lambda s: (order[s[0]], s[1], s[2]))))
    return out


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


RESULT = "struct<n_email:bigint,n_ip:bigint,n_card:bigint,n_phone:bigint,base_sha256:string,spans:string>"


def find(docs: DataFrame) -> DataFrame:
    """Per document: counts and digest of the base spans, and all spans."""
    p = trained()

    @F.arrow_udf(RESULT)
    def pii(text: pa.Array) -> pa.Array:
        got = all_spans([t or "" for t in text.to_pylist()], p)
        count = [pa.array([sum(s[0] == k for s in b) for b, _ in got], pa.int64()) for k in KINDS]
        digest = pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b, _ in got], pa.string())
        return pa.StructArray.from_arrays([*count, digest, pa.array([written(s) for _, s in got], pa.string())], names=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select("doc_id", pii(F.col("text")).alias("_p")).select("doc_id", "_p.*")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans give one."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns with personal data masked in `text`; n_chars follows."""
    p = trained()

    @F.arrow_udf("string")
    def clean(text: pa.Array) -> pa.Array:
        texts = text.to_pylist()
        got = all_spans([t or "" for t in texts], p)
        return pa.array([t if t is None else masked(t, s) for t, (_, s) in zip(texts, got, strict=True)], pa.string())

    out = docs.withColumn("text", clean(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
