"""Lossless WebP (VP8L): a decoder for all of its tools, an encoder that uses what a payload calls for, and media columns.

A stream is RIFF / WEBP / VP8L: a header, transforms, then pixels as prefix codes of literals, back-references and
colour-cache entries. The decoder reads the bit positions of a whole image at once where one set of prefix codes holds for it
all, and walks pixel by pixel otherwise."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, raw_text

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
DISTANCES = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3),
    (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5),
    (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7),
    (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6),
    (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
MAX_SIDE, CACHE_FACTOR = 16384, 0x1E35A7BD
LENGTHS, DISTANCE_CODES = 24, 40


class Corrupt(ValueError):
    """The bytes are not a whole lossless WebP image."""


class Bits:
    """A stream of bits, the low bit of each byte first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.n = data, 0, 8 * len(data)

    def read(self, n: int) -> int:
        if self.at + n > self.n:
            raise Corrupt("the data end early")
        first = self.at >> 3
        x = int.from_bytes(self.data[first : first + 5 + (n > 32)], "little") >> (self.at & 7)
        self.at += n
        return x & ((1 << n) - 1)


class Writer:
    def __init__(self):
        self.value, self.n, self.parts = 0, 0, []

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def put_codes(self, codes: np.ndarray, lengths: np.ndarray) -> None:
        """Many values of up to 32 bits each, in order."""
        ends = np.cumsum(lengths)
        place = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths)
        self.parts += [self._held(), (np.repeat(codes, lengths) >> place & 1).astype(np.uint8)]
        self.value, self.n = 0, 0

    def _held(self) -> np.ndarray:
        held = np.frombuffer(self.value.to_bytes(-(-self.n // 8), "little"), np.uint8)
        return np.unpackbits(held, bitorder="little")[: self.n]

    def bytes(self) -> bytes:
        return np.packbits(np.concatenate([*self.parts, self._held()]), bitorder="little").tobytes()


class Code:
    """A canonical prefix code: a table of all 2^width windows gives symbol and length."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.single = int(used[0]) if len(used) == 1 else None
        if not len(used):
            self.single = 0
        if self.single is not None:
            self.width, self.symbols, self.sizes = 0, np.array([self.single]), np.array([0])
            return
        own = lengths[used].astype(np.int64)
        if (1 << 15) != (1 << (15 - own)).sum():
            raise Corrupt("a prefix code is not complete")
        self.width = int(own.max())
        order = np.argsort(own, kind="stable")
        used, own = used[order], own[order]
        spans = 1 << (self.width - own)
        reverse = table_order(self.width)
        self.symbols, self.sizes = np.empty(1 << self.width, np.int32), np.empty(1 << self.width, np.int32)
        self.symbols[reverse], self.sizes[reverse] = np.repeat(used, spans), np.repeat(own, spans)
        self.table = list(zip(self.symbols.tolist(), self.sizes.tolist())) if self.width < 8 else None

    def read(self, bits: Bits) -> int:
        if self.single is not None:
            return self.single
        first = bits.at >> 3
        window = int.from_bytes(bits.data[first : first + 4], "little") >> (bits.at & 7) & ((1 << self.width) - 1)
        symbol, size = self.table[window] if self.table else (int(self.symbols[window]), int(self.sizes[window]))
        bits.at += size
        if bits.at > bits.n:
            raise Corrupt("the data end early")
        return symbol


_REVERSED = {}


def reversed_bits(x: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros_like(x)
    for i in range(width):
        out |= (x >> i & 1) << (width - 1 - i)
    return out


def table_order(width: int) -> np.ndarray:
    if width not in _REVERSED:
        _REVERSED[width] = reversed_bits(np.arange(1 << width), width)
    return _REVERSED[width]


def read_code(bits: Bits, size: int) -> Code:
    if bits.read(1):
        n = bits.read(1) + 1
        symbols = [bits.read(8 if bits.read(1) else 1)]
        if n == 2:
            symbols.append(bits.read(8))
        if max(symbols) >= size:
            raise Corrupt("a symbol is out of range")
        return Code(_one(symbols, size))
    own = [0] * 19
    for k in CODE_LENGTH_ORDER[: 4 + bits.read(4)]:
        own[k] = bits.read(3)
    left, lengths = size, [0] * size
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
        if left > size:
            raise Corrupt("too many code lengths")
    code, at, last = Code(np.array(own)), 0, 8
    while at < size and left:
        left -= 1
        x = code.read(bits)
        if x < 16:
            lengths[at] = x
            last = x or last
            at += 1
            continue
        if x == 16:
            times = 3 + bits.read(2)
        elif x == 17:
            times = 3 + bits.read(3)
        else:
            times = 11 + bits.read(7)
        if at + times > size:
            raise Corrupt("too many code lengths")
        if x == 16:
            lengths[at : at + times] = [last] * times
        at += times
    return Code(np.array(lengths))


def extra(symbol: np.ndarray | int):
    """`(bits, base)` of a length or distance symbol: its value is base + those bits + 1."""
    bits = np.maximum((symbol - 2) >> 1, 0)
    base = np.where(np.asarray(symbol) < 4, symbol, (2 + (np.asarray(symbol) & 1)) << bits)
    return bits, base


def plane_distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = DISTANCES[code - 1]
    return max(1, x + y * width)


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as ARGB values."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise Corrupt("the colour cache is too large")
    groups, which, shift = 1, None, 0
    if main and bits.read(1):
        shift = bits.read(3) + 2
        which = (read_pixels(bits, -((-width) >> shift), -((-height) >> shift), False) >> 8 & 0xFFFF).reshape(-((-height) >> shift), -((-width) >> shift))
        groups = int(which.max()) + 1
    sizes = (256 + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
    codes = [[read_code(bits, n) for n in sizes] for _ in range(groups)]
    if groups == 1:
        return _pixels_at_once(bits, width, height, cache_bits, codes[0])
    return _pixels_in_turn(bits, width, height, cache_bits, codes, which, shift)


def _pixels_in_turn(bits, width, height, cache_bits, codes, which, shift) -> np.ndarray:
    out, n, at = [0] * (width * height), width * height, 0
    cache = [0] * (1 << cache_bits)
    while at < n:
        green, red, blue, alpha, far = codes[int(which[(at // width) >> shift, (at % width) >> shift])] if which is not None else codes[0]
        s = green.read(bits)
        if s < 256:
            r = red.read(bits)
            b = blue.read(bits)
            new = [alpha.read(bits) << 24 | r << 16 | s << 8 | b]
        elif s < 256 + LENGTHS:
            k, base = (int(x) for x in extra(s - 256))
            length = base + bits.read(k) + 1
            k, base = (int(x) for x in extra(far.read(bits)))
            d = plane_distance(base + bits.read(k) + 1, width)
            if d > at or at + length > n:
                raise Corrupt("a back-reference leaves the image")
            for i in range(at, at + length):
                out[i] = out[i - d]
            new = out[at : at + length]
        else:
            new = [cache[s - 256 - LENGTHS]]
        out[at : at + len(new)] = new
        at += len(new)
        if cache_bits:
            for x in new:
                cache[(x * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits)] = x
    return np.array(out, np.uint32)


def _pixels_at_once(bits, width, height, cache_bits, codes) -> np.ndarray:
    """Symbol and next position at every bit, then the chain of those that are reached, then the pixels."""
    n = width * height
    green, red, blue, alpha, far = codes
    if all(c.single is not None for c in codes[:4]) and green.single < 256:
        return np.full(n, alpha.single << 24 | red.single << 16 | green.single << 8 | blue.single, np.uint32)
    base_bit = bits.at & ~7
    raw = np.frombuffer(bits.data, np.uint8)[base_bit >> 3 :]
    limit = 8 * len(raw)  # bit positions are counted from the byte in which the pixels start
    padded = np.concatenate([raw, np.zeros(16, np.uint8)])
    near = padded[: len(raw) + 8].astype(np.uint32)
    for i in range(1, 4):
        near |= padded[i : len(raw) + 8 + i].astype(np.uint32) << np.uint32(8 * i)

    def window(at: np.ndarray, width: int) -> np.ndarray:
        at = np.minimum(at, limit + 31)
        low = near[at >> 3] >> (at & 7).astype(np.uint32)
        if width > 24:
            low = low.astype(np.int64) | padded[(at >> 3) + 4].astype(np.int64) << (32 - (at & 7))
        return low.astype(np.int64) & ((1 << width) - 1)

    def step(code: Code, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if code.single is not None:
            return np.full(len(at), code.single), at
        x = window(at, code.width)
        return code.symbols[x], at + code.sizes[x]

    spots = np.arange(limit, dtype=np.int32)
    if green.single is not None:
        symbol, at = np.full(limit, green.single, np.int32), spots
    else:
        x = (near[: len(raw), None] >> np.arange(8, dtype=np.uint32) & np.uint32((1 << green.width) - 1)).ravel()
        symbol, at = green.symbols[x], spots + green.sizes[x]
    after = at
    copies = np.flatnonzero((symbol >= 256) & (symbol < 256 + LENGTHS)) if len(green.symbols) and green.symbols.max() >= 256 else ()
    if any(c.single is None for c in (red, blue, alpha)):
        literal = np.flatnonzero(symbol < 256)
        after, where = at.copy(), at[literal]
        for c in (red, blue, alpha):
            where = step(c, where)[1]
        after[literal] = where
    if len(copies):
        after = after.copy() if after is at else after
        where = at[copies] + extra(symbol[copies] - 256)[0]
        s, where = step(far, where)
        after[copies] = where + extra(s)[0]
    # follow the chain: eight pixels a stride, then all of them
    after = np.minimum(np.append(after, limit + 1), limit + 1).astype(np.int32)
    after = np.append(after, np.int32(limit + 1))
    stride = after
    for _ in range(3):
        stride = stride[stride]
    p, chain, jump = bits.at - base_bit, [], memoryview(stride)
    for _ in range(-(-n // 8)):
        if p >= limit:
            break
        chain.append(p)
        p = jump[p]
    own = np.empty((8, len(chain)), np.int64)
    own[0] = chain
    for i in range(1, 8):
        own[i] = after[own[i - 1]]
    own = own.T.ravel()
    own = own[own < limit]
    kind = symbol[own]
    copy = (kind >= 256) & (kind < 256 + LENGTHS)
    length = np.ones(len(own), np.int64)
    first = at[own]
    if copy.any():
        k, base = extra(kind[copy] - 256)
        length[copy] = base + (window(first[copy], 32) & ((1 << k) - 1)) + 1
        s, where = step(far, first[copy] + k)
        k, base = extra(s)
        distance = base + (window(where, 32) & ((1 << k) - 1)) + 1
    ends = np.cumsum(length)
    used = int(np.searchsorted(ends, n)) + 1
    if used > len(own) or ends[used - 1] != n or after[own[used - 1]] > limit:
        raise Corrupt("the data end early")
    bits.at = base_bit + int(after[own[used - 1]])
    own, kind, copy, length, first, ends = own[:used], kind[:used], copy[:used], length[:used], first[:used], ends[:used]
    place, out = ends - length, np.zeros(n, np.uint32)
    lit = kind < 256
    where = first[lit]
    r, where = step(red, where)
    b, where = step(blue, where)
    a, _ = step(alpha, where)
    out[place[lit]] = (a << 24 | r << 16 | kind[lit] << 8 | b).astype(np.uint32)
    cached = np.flatnonzero(kind >= 256 + LENGTHS)
    jobs = np.flatnonzero(copy)
    if not len(cached) and len(jobs):
        for i, (o, m, d) in enumerate(zip(place[jobs].tolist(), length[jobs].tolist(), distance[: len(jobs)].tolist())):
            d = plane_distance(d, width)
            if d > o:
                raise Corrupt("a back-reference leaves the image")
            out[o : o + m] = out[o - d : o - d + m] if d >= m else np.resize(out[o - d : o], m)
    elif len(cached) and not len(jobs):
        # a cache entry is the last pixel before it under the same hash
        slot = (out * np.uint32(CACHE_FACTOR) >> np.uint32(32 - cache_bits)).astype(np.int64)
        slot[place[cached]] = kind[cached] - 256 - LENGTHS
        known = np.ones(n, bool)
        known[place[cached]] = False
        order = np.argsort(slot, kind="stable")
        group = np.concatenate([[True], slot[order][1:] != slot[order][:-1]])
        source = np.where(known[order], np.arange(n), -1)
        begin = np.maximum.accumulate(np.where(group, np.arange(n), 0))
        source = np.maximum.accumulate(source)
        filled = out[order][source]
        filled[source < begin] = 0
        out[order] = filled
    elif len(cached):
        cache, done = [0] * (1 << cache_bits), 0
        order = {int(j): int(d) for j, d in zip(jobs, distance[: len(jobs)])}
        for j in np.flatnonzero(~lit).tolist():
            o, m = int(place[j]), int(length[j])
            while done < o:
                x = int(out[done])
                cache[(x * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits)] = x
                done += 1
            if j in order:
                d = plane_distance(order[j], width)
                if d > o:
                    raise Corrupt("a back-reference leaves the image")
                out[o : o + m] = out[o - d : o - d + m] if d >= m else np.resize(out[o - d : o], m)
            else:
                out[o] = cache[int(kind[j]) - 256 - LENGTHS]
    return out


def _channels(argb: np.ndarray) -> np.ndarray:
    return np.stack([argb >> s & 0xFF for s in (24, 16, 8, 0)], axis=-1).astype(np.int64)


def _argb(c: np.ndarray) -> np.ndarray:
    c = (c & 0xFF).astype(np.uint32)
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _signed(x: np.ndarray) -> np.ndarray:
    return (x + 128 & 0xFF) - 128


def _block_values(pixels: np.ndarray, shift: int, width: int, height: int) -> np.ndarray:
    w = -((-width) >> shift)
    grid = pixels.reshape(-1, w)
    return np.repeat(np.repeat(grid, 1 << shift, axis=0)[:height], 1 << shift, axis=1)[:, :width]


def _average(a, b):
    return (a + b) >> 1


def predict(mode: int, left, top, top_right, top_left):
    """A predictor's value from its neighbours, each an array of four channels."""
    clamp = lambda x: np.clip(x, 0, 255)
    if mode == 11:
        by_left, by_top = np.abs(top - top_left).sum(), np.abs(left - top_left).sum()
        return left if by_left < by_top else top
    table = {
        1: lambda: left, 2: lambda: top, 3: lambda: top_right, 4: lambda: top_left,
        5: lambda: _average(_average(left, top_right), top), 6: lambda: _average(left, top_left), 7: lambda: _average(left, top),
        8: lambda: _average(top_left, top), 9: lambda: _average(top, top_right),
        10: lambda: _average(_average(left, top_left), _average(top, top_right)), 12: lambda: clamp(left + top - top_left),
        13: lambda: clamp(_average(left, top) + (np.fix((_average(left, top) - top_left) / 2)).astype(np.int64)),
    }
    return table[mode]() if mode in table else np.array([255, 0, 0, 0])


def undo_prediction(c: np.ndarray, modes: np.ndarray) -> np.ndarray:
    """Adds each pixel's prediction; rows of one mode that looks only left or only up are done at once."""
    h, w = c.shape[:2]
    c[0, 0] = c[0, 0] + (255, 0, 0, 0) & 0xFF
    c[0, 1:] = np.cumsum(np.concatenate([c[:1, 0], c[0, 1:]]), axis=0)[1:] & 0xFF
    for y in range(1, h):
        c[y, 0] = c[y, 0] + c[y - 1, 0] & 0xFF
        row = modes[y, 1:]
        if not len(row):
            continue
        if (row == row[0]).all() and row[0] in (0, 1, 2, 4, 8):
            if row[0] == 1:
                c[y] = np.cumsum(c[y], axis=0) & 0xFF
            else:
                up = {0: np.array([255, 0, 0, 0]), 2: c[y - 1, 1:], 4: c[y - 1, :-1], 8: _average(c[y - 1, :-1], c[y - 1, 1:])}[int(row[0])]
                c[y, 1:] = c[y, 1:] + up & 0xFF
            continue
        for x in range(1, w):
            right = c[y - 1, x + 1] if x + 1 < w else c[y, 0]
            c[y, x] = c[y, x] + predict(int(modes[y, x]), c[y, x - 1], c[y - 1, x], right, c[y - 1, x - 1]) & 0xFF
    return c


def do_prediction(c: np.ndarray, modes: np.ndarray) -> np.ndarray:
    out, (h, w) = c.copy(), c.shape[:2]
    for y in range(h):
        for x in range(w):
            if y == 0:
                p = c[0, x - 1] if x else np.array([255, 0, 0, 0])
            elif x == 0:
                p = c[y - 1, 0]
            else:
                right = c[y - 1, x + 1] if x + 1 < w else c[y, 0]
                p = predict(int(modes[y, x]), c[y, x - 1], c[y - 1, x], right, c[y - 1, x - 1])
            out[y, x] = c[y, x] - p & 0xFF
    return out


def shift_by_green(pixels: np.ndarray, sign: int) -> np.ndarray:
    """Adds green to red and to blue, or takes it away, each within its own eight bits."""
    low, green = pixels & np.uint32(0x00FF00FF), pixels >> np.uint32(8) & np.uint32(0xFF)
    both = green * np.uint32(0x00010001)
    moved = low + both if sign > 0 else (low | np.uint32(0x01000100)) - both
    return pixels & np.uint32(0xFF00FF00) | moved & np.uint32(0x00FF00FF)


def cross_colour(c: np.ndarray, elements: np.ndarray, sign: int) -> np.ndarray:
    """Adds (sign 1) or takes away what green and red tell of red and blue; an element is red-to-blue, green-to-blue, green-to-red."""
    e = _channels(elements)
    delta = lambda k, x: _signed(e[..., k]) * _signed(x) >> 5
    red = c[..., 1] + sign * delta(3, c[..., 2]) & 0xFF
    blue = c[..., 3] + sign * (delta(2, c[..., 2]) + delta(1, red if sign > 0 else c[..., 1])) & 0xFF
    return np.stack([c[..., 0], red, c[..., 2], blue], axis=-1)


def decode(data: bytes) -> np.ndarray:
    """ARGB pixels (height x width) of a lossless WebP file."""
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise Corrupt("not a lossless WebP file")
    size = int.from_bytes(data[16:20], "little")
    if len(data) < 20 + size:
        raise Corrupt("the data end early")
    bits = Bits(data[21 : 20 + size])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise Corrupt("an unknown version")
    transforms, w = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in [t[0] for t in transforms]:
            raise Corrupt("a transform stands twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            shift = bits.read(3) + 2
            own = read_pixels(bits, -((-w) >> shift), -((-height) >> shift), False)
            transforms.append((kind, w, _block_values(own, shift, w, height)))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            colours = _argb(np.cumsum(_channels(read_pixels(bits, n, 1, False)), axis=0))
            per = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            transforms.append((kind, w, (colours, per)))
            w = -((-w) >> per)
        else:
            transforms.append((kind, w, None))
    pixels = read_pixels(bits, w, height, True).reshape(height, w)
    for kind, w, own in reversed(transforms):
        if kind == PALETTE:
            colours, per = own
            index = pixels >> 8 & 0xFF
            if per:
                each = 8 >> per
                index = np.stack([index >> (each * i) & ((1 << each) - 1) for i in range(1 << per)], axis=-1).reshape(height, -1)[:, :w]
            pixels = np.append(colours, np.zeros(256, np.uint32))[index]
            continue
        if kind == PREDICTOR:
            pixels = _argb(undo_prediction(_channels(pixels), own >> 8 & 0xF))
        elif kind == CROSS_COLOUR:
            pixels = _argb(cross_colour(_channels(pixels), own, 1))
        else:
            pixels = shift_by_green(pixels, 1)
    return pixels


def code_lengths(counts: np.ndarray, most: int = 15) -> np.ndarray:
    """Lengths of a complete prefix code near the counts' entropy; a single symbol has length 1."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    own = counts[used]
    lengths = np.clip(np.ceil(np.log2(own.sum() / own) - 1e-9).astype(np.int64), 1, most)
    order = np.argsort(-own, kind="stable").tolist()
    spare, x = (1 << most) - int((1 << (most - lengths)).sum()), lengths.tolist()
    while spare < 0:  # too many short codes under the limit: lengthen the rarest that can be
        for k in reversed(order):
            if x[k] < most and spare < 0:
                spare += 1 << (most - x[k] - 1)
                x[k] += 1
    while spare:
        for k in order:
            gain = 1 << (most - x[k])
            if gain <= spare:
                spare -= gain
                x[k] -= 1
    out[used] = x
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code words, the first bit lowest."""
    out = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    if len(used) < 2:
        return out
    order = used[np.argsort(lengths[used], kind="stable")]
    own = lengths[order]
    spans = 1 << (15 - own)
    starts = np.cumsum(spans) - spans  # the code words, filled up to 15 bits
    out[order] = table_order(15)[starts]
    return out


def write_code(out: Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        out.put(1, 1)
        out.put(len(used) - 1, 1)
        out.put(int(used[0] > 1), 1)
        out.put(used[0], 8 if used[0] > 1 else 1)
        if len(used) == 2:
            out.put(used[1], 8)
        return
    if len(used) == 1:  # one symbol past 255: a second of the same length makes the code complete
        lengths = lengths.copy()
        lengths[0] = 1
        used = [0, *used]
    tokens, at = [], 0
    for s in used:
        gap = s - at
        while gap > 10:
            n = min(gap, 138)
            tokens.append((18, n - 11, 7))
            gap -= n
        if gap > 2:
            tokens.append((17, gap - 3, 3))
        else:
            tokens += [(0, 0, 0)] * gap
        tokens.append((int(lengths[s]), 0, 0))
        at = s + 1
    own = code_lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)
    if (own > 0).sum() == 1:
        own[17 if own[17] == 0 else 18] = 1
    words = canonical(own).tolist()
    order = [int(own[k]) for k in CODE_LENGTH_ORDER]
    n = max(4, max(i for i, x in enumerate(order) if x) + 1)
    out.put(0, 1)
    out.put(n - 4, 4)
    for x in order[:n]:
        out.put(x, 3)
    out.put(1, 1)
    k = max(0, -(-(max(2, (len(tokens) - 2).bit_length()) - 2) // 2))
    out.put(k, 3)
    out.put(len(tokens) - 2, 2 + 2 * k)
    own = own.tolist()
    for s, bits, n in tokens:
        out.put(words[s] | bits << own[s], own[s] + n)


def _value_symbol(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, number of extra bits and those bits, for lengths or distance codes from 1 on."""
    v = x - 1
    top = np.floor(np.log2(np.maximum(v, 1))).astype(np.int64)
    bits = np.where(v < 4, 0, top - 1)
    symbol = np.where(v < 4, v, 2 * top + (v >> np.maximum(top - 1, 0) & 1))
    return symbol, bits, v & ((1 << bits) - 1)


def back_references(pixels: np.ndarray, least: int = 4, most: int = 4096) -> list[tuple[int, int, int]]:
    """`(place, length, distance)` where the pixels repeat at one distance: that of the next place of the pixels in the middle."""
    n, raw = len(pixels), pixels.astype("<u4").tobytes()
    found: list[tuple[int, int, int]] = []
    if n < 32:
        return found
    seen = set()
    for at in (n // 2, n // 4):
        key = raw[4 * at : 4 * at + 32]
        k = raw.find(key, 4 * at + 4)
        while k >= 0 and k % 4:
            k = raw.find(key, k + 1)
        if k > 0:
            seen.add(k // 4 - at)
    if not seen:
        return found
    best = max(seen, key=lambda d: int((pixels[d:] == pixels[:-d]).sum()))
    same = np.concatenate([[False], pixels[best:] == pixels[:-best], [False]])
    edge = np.flatnonzero(np.diff(same.astype(np.int8)))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        while b - a >= least:
            m = min(b - a, most)
            found.append((a + best, m, best))
            a += m
    return found


def _one(symbols: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    out[symbols] = 1
    return out


def write_pixels(out: Writer, pixels: np.ndarray, width: int, main: bool, cache_bits: int = 0, copies: list[tuple[int, int, int]] = ()) -> None:
    """One group of prefix codes; pixels within `copies` are back-references, others literals or colour-cache entries."""
    n = len(pixels)
    whole = np.ones(n, bool)
    for at, m, _ in copies:
        whole[at + 1 : at + m] = False
    place = np.flatnonzero(whole) if len(copies) else np.arange(n)
    copied = np.zeros(n, np.int64)
    if len(copies):
        copied[[c[0] for c in copies]] = np.arange(1, len(copies) + 1)
        copied = copied[place]
    own = pixels[place].astype(np.int64)
    symbol = own >> 8 & 255
    others = int(own[0]) & ~0xFF00 if n and ((own & ~0xFF00) == (int(own[0]) & ~0xFF00)).all() else None  # red, blue and alpha of all
    if cache_bits:
        slot = (pixels.astype(np.uint32) * np.uint32(CACHE_FACTOR) >> np.uint32(32 - cache_bits)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        before = np.zeros(n, bool)
        before[order[1:]] = (slot[order][1:] == slot[order][:-1]) & (pixels[order][1:] == pixels[order][:-1])
        hit = before[place]
        symbol[hit] = 256 + LENGTHS + slot[place][hit]
    is_copy = copied > 0
    literal = (symbol < 256) & ~is_copy
    if len(copies):
        c = np.array(copies, np.int64)[copied[is_copy] - 1]
        length, length_bits, length_extra = _value_symbol(c[:, 1])
        symbol[is_copy] = 256 + length
        near = {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(DISTANCES)))}
        far, far_bits, far_extra = _value_symbol(np.array([near.get(int(d), int(d) + 120) for d in c[:, 2]]))
    sizes = (256 + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
    colours = [own >> k & 255 for k in (16, 0, 24)] if others is None else [np.array([others >> k & 255]) for k in (16, 0, 24)]
    used = (symbol, *(x[literal] if others is None else x for x in colours), far if len(copies) else np.zeros(0, np.int64))
    lengths = [code_lengths(np.bincount(x, minlength=m)) if len(x) > 1 else _one(x, m) for x, m in zip(used, sizes)]
    if np.count_nonzero(lengths[0]) == 1 and not lengths[0][:256].any():
        lengths[0][0] = 1
    many = [np.count_nonzero(x) > 1 for x in lengths]
    words = [canonical(x) if m else None for x, m in zip(lengths, many)]
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    for x in lengths:
        write_code(out, x)
    zero = np.zeros(len(place), np.int64)
    columns = [(words[0][symbol], lengths[0][symbol]) if many[0] else (zero, zero)]
    for k, x in enumerate(colours, 1):
        if many[k]:
            columns.append((np.where(literal, words[k][x], 0), np.where(literal, lengths[k][x], 0)))
    if len(copies):
        named = (words[4][far], lengths[4][far]) if many[4] else (np.zeros_like(far), np.zeros_like(far))
        for value, bits in ((length_extra, length_bits), named, (far_extra, far_bits)):
            v, b = zero.copy(), zero.copy()
            v[is_copy], b[is_copy] = value, bits
            columns.append((v, b))
    if len(columns) == 1:
        out.put_codes(*columns[0])
    else:
        out.put_codes(np.stack([c[0] for c in columns], axis=1).ravel(), np.stack([c[1] for c in columns], axis=1).ravel())


def _palette(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct colours in order, and each pixel's place among them; greys need no sorting."""
    low = (pixels & 0xFF).astype(np.uint8)
    if (pixels == low.astype(np.uint32) * 0x010101 + 0xFF000000).all():
        used = np.flatnonzero(np.bincount(low.ravel(), minlength=256))
        place = np.zeros(256, np.int64)
        place[used] = np.arange(len(used))
        return used.astype(np.uint32) * np.uint32(0x010101) + np.uint32(0xFF000000), place[low]
    colours, index = np.unique(pixels, return_inverse=True)
    return colours, index.reshape(pixels.shape)


def encode(argb: np.ndarray, palette: bool = False, predictor: int | None = None, cross: tuple[int, int, int] | None = None, subtract_green: bool = False, cache_bits: int = 0, repeats: bool = False) -> bytes:
    """A lossless WebP file of ARGB pixels (height x width), with the tools asked for. `palette` needs 256 colours at most."""
    height, width = argb.shape
    if not (0 < height <= MAX_SIDE and 0 < width <= MAX_SIDE):
        raise ValueError("an image has 1 to 16384 pixels a side")
    out, pixels, w = Writer(), argb.astype(np.uint32), width
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(int((argb >> 24 != 255).any()), 1)
    out.put(0, 3)
    if predictor is not None:
        out.put(1 | PREDICTOR << 1 | 7 << 3, 6)
        blocks = np.full(-((-w) >> 9) * -((-height) >> 9), 0xFF000000 | predictor << 8, np.uint32)
        write_pixels(out, blocks, -((-w) >> 9), False)
        pixels = _argb(do_prediction(_channels(pixels), np.full((height, w), predictor)))
    if cross is not None:
        out.put(1 | CROSS_COLOUR << 1 | 7 << 3, 6)
        element = np.uint32(0xFF000000 | cross[0] << 16 | cross[1] << 8 | cross[2])
        write_pixels(out, np.full(-((-w) >> 9) * -((-height) >> 9), element, np.uint32), -((-w) >> 9), False)
        pixels = _argb(cross_colour(_channels(pixels), np.full((height, w), element), -1))
    if subtract_green:
        out.put(1 | SUBTRACT_GREEN << 1, 3)
        pixels = shift_by_green(pixels, -1)
    if palette:
        colours, index = _palette(pixels)
        n = len(colours)
        out.put(1 | PALETTE << 1 | (n - 1) << 3, 11)
        write_pixels(out, _argb(np.diff(_channels(colours), axis=0, prepend=np.zeros((1, 4), np.int64))), n, False)
        per = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
        if per:
            each = 8 >> per
            index = np.pad(index, ((0, 0), (0, -w % (1 << per)))).reshape(height, -1, 1 << per)
            index = (index << (each * np.arange(1 << per))).sum(axis=-1)
        w = index.shape[1]
        pixels = (0xFF000000 | index << 8).astype(np.uint32)
    out.put(0, 1)
    flat = pixels.ravel()
    write_pixels(out, flat, w, True, cache_bits, back_references(flat) if repeats else ())
    body = b"\x2f" + out.bytes()
    padded = body + b"\0" * (len(body) & 1)
    return b"RIFF" + (12 + len(padded)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + padded


#: A payload is a multiple of UNIT bytes: one row of grey pixels. An image has IMAGE_ROWS at most.
UNIT, IMAGE_ROWS = 64, 4096


def entropy(values: np.ndarray) -> float:
    p = np.bincount(values, minlength=256) / max(1, len(values))
    return -float((p[p > 0] * np.log2(p[p > 0])).sum())


def store(payload: bytes) -> bytes:
    """The payload as grey images, UNIT pixels wide and of IMAGE_ROWS rows at most, one file after the other, so that writing
    and reading take the memory of one image whatever the payload's length.

    Up to 16 values are indexed by a palette. Others take the pixel to the left as prediction where that saves half a bit a
    pixel or more, and are reduced to their green channel in any case."""
    out = []
    for at in range(0, max(len(payload), 1), UNIT * IMAGE_ROWS):
        grey = np.frombuffer(payload[at : at + UNIT * IMAGE_ROWS], np.uint8)
        few = np.count_nonzero(np.bincount(grey)) <= 16
        left = 1 if not few and entropy(np.diff(grey, prepend=grey[:1])) + 0.5 < entropy(grey) else None
        argb = grey.astype(np.uint32) * np.uint32(0x010101) + np.uint32(0xFF000000)
        out.append(encode(argb.reshape(-1, UNIT), palette=few, predictor=left, subtract_green=not few, repeats=True))
    return b"".join(out)


def load(media: bytes) -> bytes:
    """The samples of grey images that follow each other, row after row."""
    out, at = [], 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append((decode(media[at : at + size]) & 0xFF).astype(np.uint8).tobytes())
        at += size
    return b"".join(out)


def feature(samples: bytes) -> str:
    """Of the samples read back: mean, variance, entropy in bits, mean step between neighbours, the commonest sample."""
    x = np.frombuffer(samples, np.uint8)
    hist = np.bincount(x, minlength=256)
    p, at = hist / len(x), np.arange(256)
    mean = float((p * at).sum())
    entropy = -float((p[p > 0] * np.log2(p[p > 0])).sum())
    step = float(np.abs(np.diff(x.astype(np.int16))).mean())
    return f"mean={mean:.4f};var={float((p * (at - mean) ** 2).sum()):.4f};entropy={entropy:.4f};step={step:.4f};mode={int(hist.argmax())}"


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media, media_bytes, media_sha256, feature)` for every row.

    The payload is the text's UTF-8 with zero bytes up to a positive multiple of UNIT; it is stored as a lossless WebP image,
    or several for one of over UNIT * IMAGE_ROWS bytes, and all but `n_bytes` and `media` is of the bytes read back from it.
    Other columns, whatever their names, are not read. Null text counts as empty. Ids may be null or stand
    on several rows. Equal texts have equal values; an empty table gives no rows."""
    fields = (("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media", pa.binary()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()))
    schema = pa.schema([("doc_id", pa.int64()), *fields])

    def columns_of(text: bytes) -> tuple:
        payload = text + bytes(-len(text) % UNIT or (0 if text else UNIT))
        media = store(payload)
        back = load(media)
        sha = hashlib.sha256
        return len(text), len(back), sha(back).hexdigest(), zlib.crc32(back[-UNIT:]), media, len(media), sha(media).hexdigest(), feature(back)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                rows = [columns_of(t) for t in column(part, "_text").to_pylist()]
                cols = [column(part, "doc_id"), *(pa.array(list(c), t) for c, (_, t) in zip(zip(*rows), fields))]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    rows = raw_text(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media binary, media_bytes long, media_sha256 string, feature string")


def op5_webp(spark, sf_dir: str) -> DataFrame:
    return media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("media")
