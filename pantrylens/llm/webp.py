"""Media columns: lossless WebP (VP8L), written and read in numpy.

The decoder follows the public bitstream specification: prefix codes,
back-references, colour cache, and the predictor, cross-colour, subtract-green
and palette transforms.  Images of a batch that use one group of prefix codes
are decoded side by side, one symbol of every image per step; streams with
several groups go through a plain decoder.  The encoder writes prefix-coded
images with back-references and a colour cache, a palette where an image has at
most 16 colours, and elsewhere the transforms asked for; `fitted` chooses the
predictor and the colour multipliers of every image.
"""

from __future__ import annotations

import functools
import struct

import numpy as np

CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
HASH = 0x1E35A7BD
MAX_SIDE, MAX_COPY, MIN_COPY = 16384, 4096, 4
#: Longest code that is written, in bits, where it has room for all symbols: short ones keep the tables of the decoder small.
MAX_CODE = 9
PREDICTOR, CROSS, GREEN, PALETTE = range(4)


@functools.cache
def near_offsets() -> tuple[tuple[int, int], ...]:
    """The 120 neighbours that short distance codes name: by distance, then lower rows' order of the specification."""
    return tuple(sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, -p[1], -p[0])))


def distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = near_offsets()[code - 1]
    return max(1, x + y * width)


# --- reading ---------------------------------------------------------------------


class Bits:
    def __init__(self, data: bytes, pos: int = 0) -> None:
        self.data, self.pos = data, pos

    def peek(self) -> int:
        at = self.pos >> 3
        return int.from_bytes(self.data[at : at + 8], "little") >> (self.pos & 7)

    def read(self, n: int) -> int:
        x = self.peek() & ((1 << n) - 1)
        self.pos += n
        if self.pos > 8 * len(self.data):
            raise ValueError("the image ends early")
        return x


def reversed_bits(m: int) -> np.ndarray:
    x = np.arange(1 << m)
    out = np.zeros_like(x)
    for i in range(m):
        out |= ((x >> i) & 1) << (m - 1 - i)
    return out


_REVERSED = functools.cache(reversed_bits)


def tables(lengths: np.ndarray, need: int | None = None) -> tuple[np.ndarray, int]:
    """Lookup by the next m bits for many codes (one in each row): symbol << 4 | length."""
    used = (lengths > 0).sum(1)
    m = int(lengths.max(initial=0))
    single = used <= 1
    kraft = np.where(lengths > 0, 1 << (m - lengths), 0).sum(1)
    if (~single & (kraft != 1 << m)).any():
        raise ValueError("a prefix code is over- or undersubscribed")
    key = np.where(lengths > 0, lengths, 99).astype(np.uint8)
    order = np.argsort(key, axis=1, kind="stable")
    sorted_len = np.take_along_axis(lengths, order, 1)
    reps = np.where(sorted_len > 0, 1 << (m - sorted_len), 0)
    reps[single] = 0
    reps[single, 0] = 1 << m
    sorted_len = np.where(single[:, None], 0, sorted_len)
    flat = np.repeat((order << 4 | sorted_len).ravel().astype(np.int32), reps.ravel()).reshape(len(lengths), 1 << m)
    return np.ascontiguousarray(flat[:, _REVERSED(m)]), m


@functools.lru_cache(4096)
def _first_table(lengths: bytes) -> tuple[list[int], int]:
    table, m = tables(np.frombuffer(lengths, np.int64)[None])
    return table[0].tolist(), (1 << m) - 1


def read_code(b: Bits, size: int) -> np.ndarray:
    """Code lengths of one prefix code; a code of one symbol has the single length 1 (read with no bits)."""
    out = np.zeros(size, np.int64)
    if b.read(1):
        two, wide = b.read(1), b.read(1)
        out[b.read(8 if wide else 1)] = 1
        if two:
            out[b.read(8)] = 1
        return out
    n = 4 + b.read(4)
    first = np.zeros((1, 19), np.int64)
    for i in range(n):
        first[0, CODE_LENGTH_ORDER[i]] = b.read(3)
    table, mask = _first_table(first.tobytes())
    left = 2 + b.read(2 + 2 * b.read(3)) if b.read(1) else size
    at, before = 0, 8
    while at < size and left:
        left -= 1
        bits = b.peek()
        e = table[bits & mask]
        s, k = e >> 4, e & 15
        b.pos += k
        if s < 16:
            out[at] = s
            at += 1
            before = s or before
            continue
        extra, base = ((2, 3), (3, 3), (7, 11))[s - 16]
        run = base + ((bits >> k) & ((1 << extra) - 1))
        b.pos += extra
        if s == 16:
            out[at : at + run] = before
        at += run
    if at > size:
        raise ValueError("too many code lengths")
    return out


def read_group(b: Bits, cache_bits: int) -> list[np.ndarray]:
    return [read_code(b, n) for n in (280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)]


def _prefix_value(code: int, b: Bits) -> int:
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + b.read(extra) + 1


def read_pixels(b: Bits, width: int, height: int, cache_bits: int, groups: list, meta: np.ndarray | None, bits: int) -> np.ndarray:
    """The plain decoder of one image's symbols."""
    ready = []
    for g in groups:
        row = [tables(x[None]) for x in g]
        ready.append([(t[0].tolist(), (1 << m) - 1) for t, m in row])
    out, n = [0] * (width * height), 0
    cache = [0] * (1 << cache_bits) if cache_bits else []

    def symbol(code) -> int:
        e = code[0][b.peek() & code[1]]
        b.pos += e & 15
        if b.pos > 8 * len(b.data):
            raise ValueError("the image ends early")
        return e >> 4

    while n < len(out):
        g = ready[int(meta[(n // width) >> bits, (n % width) >> bits])] if meta is not None else ready[0]
        s = symbol(g[0])
        if s < 256:
            r, bl, a = symbol(g[1]), symbol(g[2]), symbol(g[3])
            new = [a << 24 | r << 16 | s << 8 | bl]
        elif s < 280:
            length = _prefix_value(s - 256, b)
            d = distance(_prefix_value(symbol(g[4]), b), width)
            if d > n or n + length > len(out):
                raise ValueError("a back-reference leaves the image")
            new = [out[n - d + i % d] for i in range(length)]
        else:
            new = [cache[s - 280]]
        for p in new:
            out[n] = p
            n += 1
            if cache_bits:
                cache[((p * HASH) & 0xFFFFFFFF) >> (32 - cache_bits)] = p
    return np.array(out, np.uint32).reshape(height, width)


def read_sub_image(b: Bits, width: int, height: int) -> np.ndarray:
    cache_bits = b.read(4) if b.read(1) else 0
    group = read_group(b, cache_bits)
    only = [np.flatnonzero(x) for x in group[:4]]
    if all(len(x) == 1 for x in only) and only[0][0] < 256:  # one colour: no symbol takes a bit
        green, red, blue, alpha = (int(x[0]) for x in only)
        return np.full((height, width), alpha << 24 | red << 16 | green << 8 | blue, np.uint32)
    return read_pixels(b, width, height, cache_bits, [group], None, 0)


class Image:
    """A parsed header: everything up to the codes of the main image, or with several groups of codes, up to its symbols."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20:21] != b"\x2f":
            raise ValueError("not a lossless WebP image")
        b = self.bits = Bits(data[20 : 20 + struct.unpack("<I", data[16:20])[0]], 8)
        self.width, self.height = b.read(14) + 1, b.read(14) + 1
        b.read(1)
        if b.read(3):
            raise ValueError("unknown version")
        self.transforms, self.inner = [], self.width
        self.meta, self.meta_bits = None, 0
        while b.read(1):
            kind = b.read(2)
            if kind in (PREDICTOR, CROSS):
                bits = b.read(3) + 2
                side = lambda n, bits=bits: (n + (1 << bits) - 1) >> bits
                self.transforms.append((kind, bits, self.inner, read_sub_image(b, side(self.inner), side(self.height))))
            elif kind == GREEN:
                self.transforms.append((kind, 0, self.inner, None))
            else:
                size = b.read(8) + 1
                table = read_sub_image(b, size, 1)[0]
                shift = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
                self.transforms.append((kind, shift, self.inner, _joined(np.cumsum(_split(table), axis=0, dtype=np.uint8))))
                self.inner = (self.inner + (1 << shift) - 1) >> shift
        self.cache_bits = b.read(4) if b.read(1) else 0
        if b.read(1):
            self.meta_bits = b.read(3) + 2
            side = lambda n: (n + (1 << self.meta_bits) - 1) >> self.meta_bits
            self.meta = (read_sub_image(b, side(self.inner), side(self.height)) >> 8) & 0xFFFF
            n = int(self.meta.max()) + 1
            self.groups = [read_group(b, self.cache_bits) for _ in range(n)]


def _split(argb: np.ndarray) -> np.ndarray:
    """uint32 pixels -> (..., 4) bytes in the order blue, green, red, alpha."""
    return np.ascontiguousarray(argb, "<u4").view(np.uint8).reshape(*argb.shape, 4)


def _joined(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels).view("<u4")[..., 0]


def _average(a, b):
    return ((a.astype(np.int16) + b) >> 1).astype(np.uint8)


def predicted(mode: int, left, top_left, top, top_right):
    """The prediction of a mode from neighbouring pixels, (..., 4) bytes each."""
    i = lambda x: x.astype(np.int16)
    clip = lambda x: np.clip(x, 0, 255).astype(np.uint8)
    if mode == 0 or mode > 13:
        out = np.zeros_like(left)
        out[..., 3] = 255
        return out
    if mode <= 4:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return _average(_average(left, top_right), top)
    if mode == 6:
        return _average(left, top_left)
    if mode == 7:
        return _average(left, top)
    if mode == 8:
        return _average(top_left, top)
    if mode == 9:
        return _average(top, top_right)
    if mode == 10:
        return _average(_average(left, top_left), _average(top, top_right))
    if mode == 11:  # whichever of left and top is nearer to left + top - top_left
        to_left = np.abs(i(top) - top_left).sum(-1, keepdims=True)
        to_top = np.abs(i(left) - top_left).sum(-1, keepdims=True)
        return np.where(to_left < to_top, left, top)
    if mode == 12:
        return clip(i(left) + top - top_left)
    mean = i(_average(left, top))
    return clip(mean + np.trunc((mean - top_left) / 2).astype(np.int16))


def undo_predictor(argb: np.ndarray, bits: int, modes: np.ndarray) -> np.ndarray:
    h, w = argb.shape
    x = _split(argb).copy()
    kinds = (modes >> 8) & 15
    x[0, 0, 3] = (int(x[0, 0, 3]) + 255) & 255
    for c in range(1, w):
        x[0, c] += x[0, c - 1]
    for r in range(1, h):
        up = x[r - 1]
        x[r, 0] += up[0]
        for c in range(1, w):
            # beyond the right edge the next row's first pixel stands in
            right = up[c + 1] if c + 1 < w else x[r, 0]
            x[r, c] += predicted(int(kinds[r >> bits, c >> bits]), x[r, c - 1], up[c - 1], up[c], right)
    return _joined(x)


def undo_predictors(parts: list[np.ndarray], bits: int, modes: list[np.ndarray]) -> list[np.ndarray]:
    """undo_predictor for images of one width, a row of all images per step; modes 0 to 4 only."""
    order = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
    heights = np.array([len(parts[i]) for i in order])
    start = np.cumsum(heights) - heights
    x = np.concatenate([parts[i] for i in order])
    w = x.shape[1]
    kinds = np.concatenate([(modes[i] >> 8) & 15 for i in order])
    blocks = np.array([len(modes[i]) for i in order])
    first = np.cumsum(blocks) - blocks
    add = lambda a, b: _joined(_split(a) + _split(b))
    head = _split(x[start])
    head[:, 0, 3] += 255
    x[start] = _joined(np.cumsum(head, axis=1, dtype=np.uint8))
    column = np.arange(w)
    for r in range(1, int(heights[0])):
        n = int((heights > r).sum())
        at = start[:n] + r
        up, row = x[at - 1], x[at]
        kind = np.repeat(kinds[first[:n] + (r >> bits)], 1 << bits, 1)[:, :w]
        row[:, 0] = add(row[:, 0], up[:, 0])
        right = np.concatenate([up[:, 1:], row[:, :1]], 1)
        corner = np.concatenate([up[:, :1], up[:, :-1]], 1)
        guess = np.select([kind == 0, kind == 2, kind == 3, kind == 4], [np.uint32(0xFF000000), up, right, corner], np.uint32(0))
        guess[:, 0] = 0
        row = add(row, guess)
        left = kind == 1
        left[:, 0] = False
        if left.any():  # from the pixel before a stretch of mode 1, residuals add up
            anchor = np.maximum.accumulate(np.where(left, 0, column), 1)
            steps = np.cumsum(np.where(left[..., None], _split(row), np.uint8(0)), axis=1, dtype=np.uint8)
            row = _joined(np.take_along_axis(_split(row) - steps, anchor[..., None], 1) + steps)
        x[at] = row
    out: list = [None] * len(parts)
    for i, a, h in zip(order, start.tolist(), heights.tolist(), strict=True):
        out[i] = x[a : a + h]
    return out


@functools.cache
def _deltas(multiplier: int) -> np.ndarray:
    """What a multiplier (a signed byte in 32nds) makes of every byte."""
    signed = np.arange(256).astype(np.uint8).view(np.int8).astype(np.int32)
    return ((signed * int(np.uint8(multiplier).view(np.int8))) >> 5).astype(np.uint8)


def _cross_by(argb: np.ndarray, element: int, sign: int) -> np.ndarray:
    """_cross with the same multipliers everywhere."""
    by = lambda shift, channel: _deltas(element >> shift & 255)[channel] * np.uint8(sign & 255)
    x = _split(argb).copy()
    if element & 0xFF:
        x[..., 2] += by(0, x[..., 1])
    if element & 0xFF00:
        x[..., 0] += by(8, x[..., 1])
    if element & 0xFF0000:
        x[..., 0] += by(16, x[..., 2] if sign > 0 else _split(argb)[..., 2])
    return _joined(x)


def _cross(argb: np.ndarray, bits: int, elements: np.ndarray, sign: int) -> np.ndarray:
    h, w = argb.shape
    if (elements == elements[0, 0]).all():
        return _cross_by(argb, int(elements[0, 0]), sign)
    e = _split(np.repeat(np.repeat(elements, 1 << bits, 0), 1 << bits, 1)[:h, :w]).astype(np.int8).astype(np.int32)
    x = _split(argb).astype(np.int32)
    s8 = lambda v: v.astype(np.uint8).astype(np.int8).astype(np.int32)
    delta = lambda t, c: (t * s8(c)) >> 5
    green, red, blue = x[..., 1], x[..., 2], x[..., 0]
    new_red = red + sign * delta(e[..., 0], green)
    base = new_red if sign > 0 else red
    new_blue = blue + sign * (delta(e[..., 1], green) + delta(e[..., 2], base & 255))
    return _joined(np.stack([new_blue & 255, green, new_red & 255, x[..., 3]], -1).astype(np.uint8))


def undo_many(images: list[Image], argb: list[np.ndarray]) -> list[np.ndarray]:
    """undo for many images; those whose last transform to invert is a predictor of modes 0 to 4 share its steps."""
    argb, together, rest = list(argb), {}, [image.transforms for image in images]
    for i, image in enumerate(images):
        if image.transforms and image.transforms[0][0] == PREDICTOR and not ((image.transforms[0][3] >> 8) & 15 > 4).any():
            argb[i] = _inverted(image.transforms[1:], argb[i])
            rest[i] = []
            together.setdefault((image.width, image.transforms[0][1]), []).append(i)
    for (_, bits), part in together.items():
        for i, x in zip(part, undo_predictors([argb[i] for i in part], bits, [images[i].transforms[0][3] for i in part]), strict=True):
            argb[i] = x
    return [_split(_inverted(t, x))[..., [2, 1, 0, 3]] for t, x in zip(rest, argb, strict=True)]


def _inverted(transforms: list[tuple], argb: np.ndarray) -> np.ndarray:
    """Pixels with the transforms inverted, last first."""
    for kind, bits, width, data in reversed(transforms):
        if kind == PREDICTOR:
            argb = undo_predictor(argb, bits, data)
        elif kind == CROSS:
            argb = _cross(argb, bits, data, 1) if (data & 0xFFFFFF).any() else argb
        elif kind == GREEN:
            x = _split(argb).copy()
            x[..., 0] += x[..., 1]
            x[..., 2] += x[..., 1]
            argb = _joined(x)
        else:
            index = (argb >> 8) & 255
            if bits:
                per = 8 >> bits
                parts = (index[..., None] >> (np.arange(1 << bits, dtype=np.uint32) * per)) & ((1 << per) - 1)
                index = parts.reshape(argb.shape[0], -1)[:, :width]
            table = np.zeros(256, np.uint32)
            table[: len(data)] = data
            argb = table[index]
    return argb


def streams(images: list[Image]) -> tuple[np.ndarray, np.ndarray]:
    """The streams of many images as words of 32 bits, and the byte at which each begins."""
    at = np.cumsum([0] + [(len(i.bits.data) + 19) // 4 * 4 for i in images])
    raw = np.zeros(int(at[-1]) // 4 + 2, "<u4")
    view = raw.view(np.uint8)
    for i, k in zip(images, at, strict=False):
        view[k : k + len(i.bits.data)] = np.frombuffer(i.bits.data, np.uint8)
    return raw.astype(np.uint64), at[:-1]


#: Code lengths that a symbol of the code for code lengths stands for at least, and its extra bits.
_RUN = np.array([1] * 16 + [3, 3, 11])
_EXTRA = np.array([0] * 16 + [2, 3, 7])


def read_groups(images: list[Image], raw: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The code lengths of the single group of many images, a row each in one array for every code; one symbol of every image per step."""
    end = at * 8 + np.array([8 * len(i.bits.data) for i in images])
    out = []
    for k in range(5):
        sizes = np.array([280 + (1 << i.cache_bits if i.cache_bits else 0) if k == 0 else 40 if k == 4 else 256 for i in images])
        lengths = np.zeros((len(images), int(sizes.max())), np.int64)
        lanes, row, left, known = [], [], [], {}
        for i, image in enumerate(images):
            b = image.bits
            if b.peek() & 1:
                code = read_code(b, int(sizes[i]))
                lengths[i, : len(code)] = code
                continue
            n = 4 + (b.read(5) >> 1)
            first = b.peek() & ((1 << 3 * n) - 1)
            b.pos += 3 * n
            lanes.append(i)
            row.append(known.setdefault((n, first), len(known)))
            left.append(2 + b.read(2 + 2 * b.read(3)) if b.read(1) else int(sizes[i]))
        out.append(lengths)
        if not lanes:
            continue
        table = np.zeros((len(known), 128), np.int64)
        for r, (n, first) in enumerate(known):
            lens = np.zeros(19, np.int64)
            lens[list(CODE_LENGTH_ORDER[:n])] = [first >> 3 * j & 7 for j in range(n)]
            entries = _first_table(lens.tobytes())[0]
            table[r] = np.tile(entries, 128 // len(entries))
        table = table.ravel()
        lane, row, left = np.array(lanes), np.array(row) << 7, np.array(left)
        pos, size, stop = at[lane] * 8 + np.array([images[i].bits.pos for i in lanes]), sizes[lane], end[lane]
        column, before = np.zeros(len(lane), np.int64), np.full(len(lane), 8)
        while len(lane):
            bits = ((raw[pos >> 5] | raw[(pos >> 5) + 1] << np.uint64(32)) >> (pos & 31).astype(np.uint64)).astype(np.int64)
            e = table[row + (bits & 127)]
            symbol, used = e >> 4, e & 15
            extra = _EXTRA[symbol]
            run = _RUN[symbol] + ((bits >> used) & ((1 << extra) - 1))
            pos, after, left = pos + used + extra, column + run, left - 1
            if (after > size).any() or (pos > stop).any():
                raise ValueError("code lengths end early, or there are too many")
            one = np.flatnonzero(symbol < 16)
            lengths[lane[one], column[one]] = symbol[one]
            for i in np.flatnonzero(symbol == 16).tolist():
                lengths[lane[i], column[i] : after[i]] = before[i]
            before = np.where((symbol < 16) & (symbol > 0), symbol, before)
            column = after
            on = (column < size) & (left > 0)
            if not on.all():
                for i in np.flatnonzero(~on).tolist():
                    images[lane[i]].bits.pos = int(pos[i] - 8 * at[lane[i]])
                lane, row, left, pos, size, stop, column, before = (v[on] for v in (lane, row, left, pos, size, stop, column, before))
    return out


def lockstep(images: list[Image]) -> list[np.ndarray]:
    """Codes and symbols of many images with one group of codes each, side by side."""
    n = len(images)
    size = np.array([i.inner * i.height for i in images])
    base = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint32)
    raw, at = streams(images)
    codes = []
    row = np.arange(n)
    for rows in read_groups(images, raw, at):
        table, m = tables(rows)
        codes.append((table.ravel(), m, np.uint64((1 << m) - 1)))
    (tg, mg, kg), (tr, mr, kr), (tb, mb, kb), (ta, ma, ka), (td, md, kd) = codes
    roomy = mg + mr + mb + ma <= 33
    lane = np.arange(n)
    pos = at * 8 + np.array([i.bits.pos for i in images])
    end = at * 8 + np.array([8 * len(i.bits.data) for i in images])
    put, stop = base.copy(), base + size
    cbits = np.array([i.cache_bits for i in images])
    shift = (32 - cbits).astype(np.uint32)
    crow = np.cumsum(np.where(cbits > 0, 1 << cbits, 0)) - np.where(cbits > 0, 1 << cbits, 0)
    cache = np.zeros(int(np.where(cbits > 0, 1 << cbits, 0).sum()) + 1, np.uint32)
    widths = [i.inner for i in images]
    some_cache, all_cache = (cbits > 0).any(), (cbits > 0).all()
    load = lambda p: (raw[p >> 5] | raw[(p >> 5) + 1] << np.uint64(32)) >> (p & 31).astype(np.uint64)
    while len(lane):
        bits = load(pos)
        e = tg[(row << mg) + (bits & kg).astype(np.int64)]
        sym, used = e >> 4, e & 15
        rest = bits >> used.astype(np.uint64)
        er = tr[(row << mr) + (rest & kr).astype(np.int64)]
        used = used + (er & 15)
        rest = bits >> used.astype(np.uint64) if roomy else load(pos + used)
        eb = tb[(row << mb) + (rest & kb).astype(np.int64)]
        used = used + (eb & 15)
        if ma:
            rest = bits >> used.astype(np.uint64) if roomy else load(pos + used)
        ea = ta[(row << ma) + ((rest & ka).astype(np.int64) if ma else 0)]
        used = used + (ea & 15)
        pixel = (((ea >> 4).astype(np.uint32) << np.uint32(24)) | ((er >> 4) << 16 | sym << 8 | eb >> 4).astype(np.uint32))
        step = 1
        odd = np.flatnonzero(sym >= 256)
        if len(odd):
            step = np.ones(len(lane), np.int64)
            hits = odd[sym[odd] >= 280]
            if len(hits):
                pixel[hits] = cache[crow[hits] + sym[hits] - 280]
                used[hits] = e[hits] & 15
            for i in odd[sym[odd] < 280].tolist():
                b = Bits(images[lane[i]].bits.data, int(pos[i] - at[lane[i]] * 8) + int(e[i] & 15))
                length = _prefix_value(int(sym[i]) - 256, b)
                x = int(td[(int(row[i]) << md) + (b.peek() & int(kd))])
                b.pos += x & 15
                d = distance(_prefix_value(x >> 4, b), widths[lane[i]])
                p = int(put[i])
                if d > p - base[lane[i]] or p + length > stop[i]:
                    raise ValueError("a back-reference leaves the image")
                whole = np.tile(out[p - d : p], length // d + 1)[:length] if d < length else out[p - d : p - d + length].copy()
                out[p : p + length] = whole
                if cbits[i]:
                    cache[crow[i] + ((whole * np.uint32(HASH)) >> shift[i]).astype(np.int64)] = whole
                pixel[i] = whole[-1]
                step[i] = length
                used[i] = b.pos + at[lane[i]] * 8 - pos[i]
        out[put + step - 1] = pixel
        if all_cache:
            cache[crow + ((pixel * np.uint32(HASH)) >> shift).astype(np.int64)] = pixel
        elif some_cache:
            c = np.flatnonzero(cbits)
            cache[crow[c] + ((pixel[c] * np.uint32(HASH)) >> shift[c]).astype(np.int64)] = pixel[c]
        pos += used
        put += step
        if (put >= stop).any():
            if (pos > end).any():
                raise ValueError("an image ends early")
            on = put < stop
            lane, row, pos, end, put, stop, cbits, shift, crow = (v[on] for v in (lane, row, pos, end, put, stop, cbits, shift, crow))
    return [out[b : b + s].reshape(i.height, i.inner) for b, s, i in zip(base, size, images, strict=True)]


def decode_many(files: list[bytes], lanes: int = 2048, pixels: int = 1 << 23) -> list[np.ndarray]:
    """RGBA pixel arrays of many files; a batch is bounded in images and in pixels."""
    images = [Image(f) for f in files]
    out: list = [None] * len(files)
    alike = sorted((i for i, x in enumerate(images) if x.meta is None), key=lambda i: -images[i].inner * images[i].height)
    a = 0
    while a < len(alike):
        z, total = a, 0
        while z < len(alike) and z - a < lanes and (z == a or total < pixels):
            total += images[alike[z]].inner * images[alike[z]].height
            z += 1
        part = alike[a:z]
        alike_now = [images[i] for i in part]
        for i, pixels_of in zip(part, undo_many(alike_now, lockstep(alike_now)), strict=True):
            out[i] = pixels_of
        a = z
    for i, x in enumerate(images):
        if out[i] is None:
            out[i] = undo_many([x], [read_pixels(x.bits, x.inner, x.height, x.cache_bits, x.groups, x.meta, x.meta_bits)])[0]
    return out


# --- writing ---------------------------------------------------------------------


class Writer:
    """Values packed lowest bit first; single ones into a running integer, many as arrays of at most 64 bits each."""

    def __init__(self) -> None:
        self.bits = self.size = 0
        self.blocks: list[tuple[np.ndarray, np.ndarray]] = []

    def put(self, value: int, size: int) -> None:
        self.bits |= value << self.size
        self.size += size

    def many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        n = (self.size + 63) // 64
        head = np.frombuffer(self.bits.to_bytes(8 * n, "little"), "<u8").astype(np.uint64)
        lengths = np.full(n, 64)
        if n:
            lengths[-1] = self.size - 64 * (n - 1)
        self.blocks += [(head, lengths), (values, sizes)]
        self.bits = self.size = 0

    def bytes(self) -> bytes:
        self.many(np.zeros(0, np.uint64), np.zeros(0, np.int64))
        v, s = np.concatenate([a for a, _ in self.blocks]), np.concatenate([b for _, b in self.blocks])
        v, s = v[s > 0], s[s > 0]
        at = np.cumsum(s) - s
        word, off = at >> 6, (at & 63).astype(np.uint64)
        n = int(at[-1] + s[-1])
        out = np.zeros((n >> 6) + 2, np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] = np.bitwise_or.reduceat(v << off, first)
        over = np.flatnonzero(off.astype(np.int64) + s > 64)  # at most one value spills from each word
        out[word[over] + 1] |= v[over] >> (np.uint64(64) - off[over])
        return out.tobytes()[: (n + 7) // 8]


def code_lengths(counts: np.ndarray, most: int = MAX_CODE) -> np.ndarray:
    """Lengths of a complete prefix code: rounded-up information content, then shortened until no code space is left."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    c, most = counts[used], max(most, len(used).bit_length())
    lengths = np.clip(np.ceil(np.log2(c.sum() / c)), 1, most).astype(int)
    left = (1 << most) - int((1 << (most - lengths)).sum())
    if not left:
        out[used] = lengths
        return out
    lengths, order = lengths.tolist(), np.argsort(-c, kind="stable").tolist()
    for i in reversed(order):  # only where the limit made codes too short
        while left < 0 and lengths[i] < most:
            left += 1 << (most - lengths[i] - 1)
            lengths[i] += 1
    for i in order:
        while (1 << (most - lengths[i])) <= left:
            left -= 1 << (most - lengths[i])
            lengths[i] -= 1
    out[used] = lengths
    return out


#: Lengths of the code for code lengths 0 to 11, 17 and 18: two of 3 bits, twelve of 4.
_FIRST = np.zeros(19, np.int64)
_FIRST[[0, 1, 2, 3, 4, 5, 8, 9, 10, 11, 17, 18]] = 4
_FIRST[[6, 7]] = 3


def codewords(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes, bits reversed for a stream that starts at the lowest bit."""
    used = np.flatnonzero(lengths)
    out = np.zeros(len(lengths), np.uint64)
    if len(used) < 2:
        return out
    order = used[np.argsort(lengths[used], kind="stable")]
    m = int(lengths.max())
    space = 1 << (m - lengths[order])
    first = np.cumsum(space) - space
    out[order] = _REVERSED(m)[first]
    return out


_FIRST_CODES = codewords(_FIRST)
#: What a code with lengths of its own opens with: 15 lengths of the first code, and no early end.
_OPENING = sum(int(_FIRST[x]) << (5 + 3 * i) for i, x in enumerate(CODE_LENGTH_ORDER[:15])) | 11 << 1
_OPENING = np.array([_OPENING], np.uint64), np.array([51])
_REST = np.arange(138)
#: By the zeros left over: the run's value and size, and the sizes of up to two single zeros.
_ZEROS = (
    np.where(_REST >= 11, int(_FIRST_CODES[18]) | (_REST - 11) << 4, int(_FIRST_CODES[17]) | (_REST - 3 & 7) << 4).astype(np.uint64),
    np.where(_REST >= 11, 11, np.where(_REST >= 3, 7, 0)),
    np.where((_REST == 1) | (_REST == 2), 4, 0),
    np.where(_REST == 2, 4, 0),
)


def code_bits(codes: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every prefix code, the values that spell it out, and their sizes (0: left out)."""
    out: list = []
    long = []
    for x in codes:
        used = np.flatnonzero(x)
        if len(used) > 2 or (len(used) and used[-1] >= 256):
            long.append((len(out), used, len(x)))
            out.append(None)
            continue
        a, two = int(used[0]) if len(used) else 0, len(used) == 2
        out.append((np.array([5 | two << 1 | a << 3 | (int(used[1]) << 11 if two else 0)], np.uint64), np.array([19 if two else 11])))
    if not long:
        return out
    # before every used symbol, and at the end of a code: whole runs of 138 zeros, a shorter run, up to two single zeros, the length itself
    marks = np.concatenate([np.append(used, n) for _, used, n in long])
    ends = np.cumsum([len(used) + 1 for _, used, _ in long])
    gap = marks - np.concatenate([[-1], marks[:-1]]) - 1
    gap[ends[:-1]] = marks[ends[:-1]]
    k = np.concatenate([np.append(codes[i][used], 0) for i, used, _ in long])
    whole, rest = gap // 138, gap % 138
    most = int(whole.max())
    value, size = np.zeros((len(gap), most + 4), np.uint64), np.zeros((len(gap), most + 4), np.int64)
    if most:
        value[:, :most], size[:, :most] = int(_FIRST_CODES[18]) | 127 << 4, np.where(np.arange(most) < whole[:, None], 11, 0)
    value[:, most], size[:, most] = _ZEROS[0][rest], _ZEROS[1][rest]
    value[:, most + 1 : most + 3] = _FIRST_CODES[0]
    size[:, most + 1], size[:, most + 2] = _ZEROS[2][rest], _ZEROS[3][rest]
    value[:, most + 3], size[:, most + 3] = _FIRST_CODES[k], np.where(k > 0, _FIRST[k], 0)
    a = 0
    for (i, _, _), z in zip(long, ends.tolist(), strict=True):
        out[i] = np.concatenate([_OPENING[0], value[a:z].ravel()]), np.concatenate([_OPENING[1], size[a:z].ravel()])
        a = z
    return out


def _prefix_code(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, extra bits, their value) of values from 1."""
    v = value - 1
    top = np.maximum(np.frexp(np.maximum(v, 1).astype(float))[1] - 1, 0)
    small = v < 4
    extra = np.where(small, 0, top - 1)
    code = np.where(small, v, 2 * top + ((v >> np.maximum(top - 1, 0)) & 1))
    return code, extra, np.where(small, 0, v & ((1 << extra) - 1))


def copies(px: np.ndarray) -> list[tuple[int, int, int]]:
    """Back-references (start, length, distance), found from earlier equal stretches of MIN_COPY pixels."""
    n = len(px) - MIN_COPY + 1
    if n < 2:
        return []
    h = np.zeros(n, np.uint64)
    for j, odd in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)):
        h += px[j : j + n] * np.uint64(odd)
    low = np.uint64(n.bit_length())
    key = np.sort((h >> low) << low | np.arange(n, dtype=np.uint64))  # by hash, then place
    order, h = (key & np.uint64((1 << int(low)) - 1)).astype(np.int64), key >> low
    same = h[1:] == h[:-1]
    if not same.any():
        return []
    prev = np.full(n, -1)
    prev[order[1:][same]] = order[:-1][same]
    out, at = [], 0
    for i in np.flatnonzero(prev >= 0).tolist():
        if i < at:
            continue
        d, k, most = i - int(prev[i]), 0, min(MAX_COPY, len(px) - i)
        while k < most:
            block = min(256, most - k)
            eq = px[i + k : i + k + block] == px[i + k - d : i + k - d + block]
            if not eq.all():
                k += int(np.argmin(eq))
                break
            k += block
        if k >= MIN_COPY:
            out.append((i, k, d))
            at = i + k
    return out


def _ready(lengths: list[np.ndarray]) -> tuple[list, list]:
    return [codewords(x) for x in lengths], [np.where((x > 0).sum() > 1, x, 0) for x in lengths]


def write_pixels(w: Writer, argb: np.ndarray, cache_bits: int, main: bool) -> None:
    """Colour cache, the single group of codes (fitted to the image), and all symbols of an image."""
    px = argb.ravel().astype(np.uint32)
    n = len(px)
    if not main and (px == px[0]).all():
        w.put(0, 1)
        for x in (*_split(px[:1])[0, [1, 2, 0, 3]].tolist(), 0):
            w.put(0b101 | x << 3, 11)
        return
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(0, 1)
    refs = copies(px)
    alive = np.ones(n, bool)
    kind = np.zeros(n, np.int8)
    for i, k, _ in refs:
        alive[i : i + k] = False
        alive[i], kind[i] = True, 2
    size = 280 + ((1 << cache_bits) if cache_bits else 0)
    slot = np.zeros(n, np.int64)
    if cache_bits:
        slot = ((px * np.uint32(HASH)) >> np.uint32(32 - cache_bits)).astype(np.int64)
        order = np.argsort(slot.astype(np.uint16), kind="stable")
        hit = np.zeros(n, bool)
        hit[order[1:]] = (slot[order][1:] == slot[order][:-1]) & (px[order][1:] == px[order][:-1])
        kind[hit & (kind == 0)] = 1
    c = _split(px)
    t = np.flatnonzero(alive)
    k = kind[t]
    green = np.where(k == 0, c[t, 1], 280 + slot[t]).astype(np.int64)
    lit = t[k == 0]
    if refs:
        r = np.array(refs)
        lc, le, lv = _prefix_code(r[:, 1])
        dc, de, dv = _prefix_code(r[:, 2] + 120)
        green[k == 2] = 256 + lc
    counts = [np.bincount(green, minlength=size), *(np.bincount(c[lit, ch], minlength=256) for ch in (2, 0, 3)), np.bincount(dc, minlength=40) if refs else np.zeros(40, np.int64)]
    lengths = [code_lengths(x) for x in counts]
    spelled = code_bits(lengths)
    words, bits = _ready(lengths)
    value, used = words[0][green], bits[0][green].copy()
    at = np.flatnonzero(k == 0)
    for j, channel in ((1, 2), (2, 0), (3, 3)):
        s = c[lit, channel]
        value[at] |= words[j][s] << used[at].astype(np.uint64)
        used[at] += bits[j][s]
    if refs:
        at = np.flatnonzero(k == 2)
        for v, b in ((lv.astype(np.uint64), le), (words[4][dc], bits[4][dc]), (dv.astype(np.uint64), de)):
            value[at] |= v << used[at].astype(np.uint64)
            used[at] += b
    w.many(np.concatenate([*(v for v, _ in spelled), value]), np.concatenate([*(k for _, k in spelled), used]))


def _cheapest(options: list[np.ndarray]) -> int:
    """The option whose bytes have the least entropy; the first where equal."""
    costs = []
    for x in options:
        n = np.bincount(x.ravel(), minlength=256)
        n = n[n > 0]
        costs.append(-(n * np.log2(n)).sum())
    return int(np.argmin(costs))


#: Predictors and colour multipliers (green to red, green to blue, red to blue) that `fitted` chooses from; 32 is one.
MODES = (0, 1, 2)
MULTIPLIERS = ((0, 0, 0), (32, 32, 0))


def fitted(argb: np.ndarray) -> tuple[int, int, np.ndarray]:
    """The pixels of the predictor's and the colour multipliers' images, chosen by the entropy of what is left, and the pixels that are left after both."""
    options = [_residual(argb, mode) for mode in MODES]
    i = _cheapest([_split(x)[..., :3] for x in options])
    left = options[i]
    elements = [0xFF000000 | rb << 16 | gb << 8 | gr for gr, gb, rb in MULTIPLIERS]
    options = [left, *(_cross_by(left, e, -1) for e in elements[1:])]
    j = _cheapest([_split(x)[..., [0, 2]] for x in options])
    return 0xFF000000 | MODES[i] << 8, elements[j], options[j]


def encode(rgba: np.ndarray, transforms: tuple | None = (), cache_bits: int | None = None, palette: bool = True, bits: int = 3, mode: int = 11) -> bytes:
    """One lossless image from (height, width, 4) RGBA bytes.

    `transforms` asks for PREDICTOR, CROSS and GREEN in that order; None asks
    for PREDICTOR and CROSS as `fitted` chooses them.  A palette is used instead
    where at most 16 colours occur and no transform is asked for by name.
    """
    h, width = rgba.shape[:2]
    if not (0 < h <= MAX_SIDE and 0 < width <= MAX_SIDE):
        raise ValueError("sides are 1 to 16384 pixels")
    argb = _joined(rgba[..., [2, 1, 0, 3]])
    w = Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(h - 1, 14)
    w.put(int((rgba[..., 3] != 255).any()), 1)
    w.put(0, 3)
    side = lambda n: (n + (1 << bits) - 1) >> bits
    few = palette and not transforms and len(np.unique(argb.ravel()[:64])) <= 16
    colours = np.unique(argb) if few else None
    if colours is not None and len(colours) > 16:
        colours = None
    if transforms is None and colours is None:
        mode_pixel, element, argb = fitted(argb)
        for t, pixel in ((PREDICTOR, mode_pixel), (CROSS, element)):
            w.put(1, 1)
            w.put(t, 2)
            w.put(bits - 2, 3)
            write_pixels(w, np.full((side(h), side(width)), pixel, np.uint32), 0, False)
    for t in transforms or ():
        w.put(1, 1)
        w.put(t, 2)
        if t == GREEN:
            x = _split(argb).copy()
            x[..., 0] -= x[..., 1]
            x[..., 2] -= x[..., 1]
            argb = _joined(x)
            continue
        w.put(bits - 2, 3)
        if t == PREDICTOR:
            sub = np.full((side(h), side(width)), 0xFF000000 | mode << 8, np.uint32)
            write_pixels(w, sub, 0, False)
            argb = _residual(argb, mode)
        else:
            sub = np.full((side(h), side(width)), 0xFF000000 | 5 << 16 | 7 << 8 | 250, np.uint32)
            write_pixels(w, sub, 0, False)
            argb = _cross(argb, bits, sub, -1)
    if colours is not None:
        w.put(1, 1)
        w.put(PALETTE, 2)
        w.put(len(colours) - 1, 8)
        table = _split(colours)
        write_pixels(w, _joined(np.diff(table, axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8))[None], 0, False)
        shift = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1
        per, each = 8 >> shift, 1 << shift
        index = np.zeros((h, (width + each - 1) // each * each), np.uint32)
        index[:, :width] = np.searchsorted(colours, argb)
        bundled = (index.reshape(h, -1, each) << (np.arange(each, dtype=np.uint32) * per)).sum(2, dtype=np.uint32)
        argb = np.uint32(0xFF000000) | bundled << np.uint32(8)
    w.put(0, 1)
    write_pixels(w, argb, (6 if argb.size >= 256 else 0) if cache_bits is None else cache_bits, True)
    data = w.bytes()
    body = b"VP8L" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body


def _residual(argb: np.ndarray, mode: int) -> np.ndarray:
    x = _split(argb)
    h, w = argb.shape
    out = x.copy()
    out[0, 0, 3] = (int(out[0, 0, 3]) - 255) & 255
    out[0, 1:] -= x[0, :-1]
    if h > 1:
        out[1:, 0] -= x[:-1, 0]
        right = np.concatenate([x[:-1, 2:], x[1:, :1]], 1) if w > 1 else x[1:, :0]
        out[1:, 1:] -= predicted(mode, x[1:, :-1], x[:-1, :-1], x[:-1, 1:], right)
    return _joined(out)


# --- payloads in images -----------------------------------------------------------

COLUMNS = TILE = 64
#: A tile is one block of both transforms.
BLOCK_BITS = 6
ROW = 3 * COLUMNS


def to_media(payload: bytes) -> bytes:
    """A payload of whole rows of 192 bytes as RGB pixels of images 64 wide and at most 64 high, joined."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, COLUMNS, 3)
    out = []
    for a in range(0, len(x), TILE):
        part = x[a : a + TILE]
        out.append(encode(np.concatenate([part, np.full((*part.shape[:2], 1), 255, np.uint8)], 2), None, bits=BLOCK_BITS))
    return b"".join(out)


def files_of(media: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(media):
        size = struct.unpack("<I", media[at + 4 : at + 8])[0] + 8
        out.append(media[at : at + size])
        at += size
    return out


def from_media(media: list[bytes]) -> list[np.ndarray]:
    """The pixel rows (height, 64, 3) of each stored form."""
    parts = [files_of(m) for m in media]
    pixels = decode_many([f for p in parts for f in p])
    out, at = [], 0
    for p in parts:
        got = [x[..., :3] for x in pixels[at : at + len(p)]]
        out.append(got[0] if len(got) == 1 else np.concatenate(got))
        at += len(p)
    return out
