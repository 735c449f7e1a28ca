"""Lossless WebP (VP8L) in NumPy: a decoder for the whole format and an encoder.

Pixels are arrays of ARGB as unsigned 32-bit integers.  The decoder reads prefix codes, literals,
back-references and the colour cache, meta prefix codes, and inverts the predictor, cross-colour,
subtract-green and palette transforms.  Images with one varying channel and no colour cache, as those
of ``encode_samples``, are read in array steps: what a code would be is looked up at every bit, and
the true codes are those on the way from the first bit.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections import Counter
from functools import lru_cache

import numpy as np

PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Largest width and height.
SIDE = 16384
#: Images of so many pixels are read in array steps, so many bytes of codes at a time.
STREAM, BLOCK = 32, 1 << 16
#: Shortest stretch that is stored as a copy, and the longest of the format.
LEAST_COPY, MOST_COPY = 8, 4096
# Fixed values of the format: the order of code length codes, and the places near a pixel by distance code.
_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
_NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1),
    (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3),
    (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7))
_BLACK = 0xFF000000


class Broken(ValueError):
    """The bytes are not a lossless WebP image."""


class Bits:
    """Bits of some bytes, the lowest first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def peek(self, n: int) -> int:
        k = self.at >> 3
        return int.from_bytes(self.data[k : k + 5], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        if self.at + n > 8 * len(self.data):
            raise Broken("the data end early")
        x = self.peek(n)
        self.at += n
        return x


@lru_cache
def _mirror(n: int) -> np.ndarray:
    """The numbers of ``n`` bits, each with its bits in reverse."""
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate([out << 1, out << 1 | 1])
    return out


def _canonical(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols by (length, symbol), their bit-reversed canonical codes, and the lengths."""
    symbols, size = (np.fromiter(x, np.int64, len(lengths)) for x in (lengths, lengths.values()))
    order = np.lexsort((symbols, size))
    symbols, size = symbols[order], size[order]
    each = 1 << 15 - size
    return symbols, _mirror(15)[(np.cumsum(each) - each) & 0x7FFF], size  # codes as fractions of 15 bits, read backwards


class Code:
    """A prefix code for reading: from the lengths of the symbols that have one."""

    def __init__(self, lengths: dict[int, int]):
        self.only = next(iter(lengths)) if len(lengths) == 1 else None  # a lone symbol takes no bits
        if self.only is not None:
            return
        self.most = most = max(lengths.values())
        symbols, size = (np.fromiter(x, np.int64, len(lengths)) for x in (lengths, lengths.values()))
        order = np.lexsort((symbols, size))
        each = 1 << most - size[order]
        if each.sum() != 1 << most:
            raise Broken("a prefix code is not complete")
        #: For what the next ``most`` bits may be: a symbol times 16, and the length of its code.
        self.packed = np.repeat((symbols << 4 | size)[order].astype(np.uint16), each)[_mirror(most)]
        self.table: list | None = None

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        if self.table is None:
            self.table = self.packed.tolist()
        x = self.table[bits.peek(self.most)]
        bits.at += x & 15
        return x >> 4


def _read_code(bits: Bits, size: int) -> Code:
    if bits.read(1):
        two = bits.read(1)
        symbols = [bits.read(8 if bits.read(1) else 1)]
        if two:
            symbols.append(bits.read(8))
        if max(symbols) >= size:
            raise Broken("a symbol is beyond its alphabet")
        return Code(dict.fromkeys(symbols, 1))
    own = {}
    for k in range(4 + bits.read(4)):
        if n := bits.read(3):
            own[_LENGTH_ORDER[k]] = n
    if not own:
        raise Broken("a prefix code has no symbol")
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    code, at, last, lengths = Code(own), 0, 8, {}
    table, most = (code.packed.tolist(), code.most) if code.only is None else ([code.only << 4], 0)
    mask, begin = (1 << most) - 1, bits.at >> 3
    ahead, used = int.from_bytes(bits.data[begin : begin + 2 * size + 16], "little"), bits.at & 7  # a symbol takes 14 bits at most
    while at < size and left:
        left -= 1
        w = ahead >> used
        x = table[w & mask]
        used += x & 15
        s = x >> 4
        if s < 16:
            if s:
                lengths[at] = last = s
            at += 1
        else:
            w >>= x & 15
            n, more = (3 + (w & 3), 2) if s == 16 else (3 + (w & 7), 3) if s == 17 else (11 + (w & 127), 7)
            used += more
            if at + n > size:
                raise Broken("code lengths run over")
            if s == 16:
                lengths.update(dict.fromkeys(range(at, at + n), last))
            at += n
    bits.at = 8 * begin + used
    if bits.at > 8 * len(bits.data):
        raise Broken("the data end early")
    if not lengths:
        raise Broken("a prefix code has no symbol")
    return Code(lengths)


def _extended(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image, as a flat array."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise Broken("the colour cache is too large")
    groups, meta, meta_bits = 1, None, 0
    if main and bits.read(1):
        meta_bits = bits.read(3) + 2
        meta = (_image(bits, -(-width >> meta_bits), -(-height >> meta_bits), False) >> 8) & 0xFFFF
        groups = int(meta.max()) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    codes = [[_read_code(bits, n) for n in (280 + cache_size, 256, 256, 256, 40)] for _ in range(groups)]
    n = width * height
    if meta is None and not cache_bits and n >= STREAM and all(c.only is not None for c in codes[0][1:4]):
        red, blue, alpha = (c.only for c in codes[0][1:4])
        return _green(bits, codes[0][0], codes[0][4], width, n).astype(np.uint32) << 8 | np.uint32(alpha << 24 | red << 16 | blue)
    out, cache = [0] * n, [0] * cache_size
    across, shift, at, held = -(-width >> meta_bits) if meta is not None else 0, 32 - cache_bits, 0, 0
    green, red, blue, alpha, far = codes[0]
    while at < n:
        if meta is not None:
            green, red, blue, alpha, far = codes[int(meta[(at // width >> meta_bits) * across + (at % width >> meta_bits)])]
        s = green.read(bits)
        if s < 256:
            r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
            out[at] = a << 24 | r << 16 | s << 8 | b
            at += 1
        elif s < 280:
            length = _extended(bits, s - 256)
            d = _extended(bits, far.read(bits))
            if d > 120:
                d -= 120
            else:
                x, y = _NEAR[d - 1]
                d = max(1, x + y * width)
            if d > at or at + length > n:
                raise Broken("a reference leaves the image")
            for k in range(at, at + length):
                out[k] = out[k - d]
            at += length
        else:
            while held < at:  # what came before enters the cache only when that is looked into
                cache[0x1E35A7BD * out[held] % (1 << 32) >> shift] = out[held]
                held += 1
            out[at] = cache[s - 280]
            at += 1
    if bits.at > 8 * len(bits.data):
        raise Broken("the data end early")
    return np.array(out, np.uint32)


def _extra(prefix: np.ndarray) -> np.ndarray:
    """How many bits follow each prefix of a length or distance."""
    return np.where(prefix < 4, 0, (prefix - 2) >> 1)


_REST = np.zeros(256, np.uint8)


def _green(bits: Bits, green: Code, far: Code, width: int, n: int) -> np.ndarray:
    """The green samples of an image in which nothing else varies."""
    if green.only is not None:
        if green.only > 255:
            raise Broken("a reference leaves the image")
        return np.full(n, green.only, np.uint8)
    size, start = len(bits.data), bits.at >> 3
    padded = bits.data + bytes(16)
    word = np.ndarray((size + 8,), "<u8", padded, 0, (1,))  # the eight bytes from each byte on

    def peek(at: np.ndarray, count: int | np.ndarray) -> np.ndarray:
        return (word[np.minimum(at >> 3, size)] >> (at & 7).astype(np.uint64)) & ((np.uint64(1) << np.uint64(count)) - np.uint64(1))

    def number(prefix: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Lengths or distances whose extra bits are at some places."""
        more = _extra(prefix)
        base = np.where(prefix < 4, prefix, (2 + (prefix & 1)) << more)
        return base + peek(at, more.astype(np.uint64)).astype(np.int64) + 1

    def distance_code(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if far.only is not None:
            return np.full(len(at), far.only, np.int64), np.zeros(len(at), np.int64)
        x = far.packed[peek(at, far.most).astype(np.int64)].astype(np.int64)
        return x >> 4, x & 15

    highest = int(green.packed.max()) >> 4
    if highest >= 280:
        raise Broken("a colour cache is missing")
    references, parts, made, at = highest > 255, [], 0, bits.at
    while made < n:
        if at >= 8 * size:
            raise Broken("the data end early")
        low, high = at >> 3, min(size, (at >> 3) + BLOCK)
        window = np.ndarray((high - low,), "<u4", padded, low, (1,))[:, None] >> np.arange(8, dtype=np.uint32)
        index = (window & np.uint32((1 << green.most) - 1)).ravel()
        packed = green.packed[index]
        step = (packed & 15).astype(np.uint8)
        maybe = np.flatnonzero(packed >= 256 << 4) if references else index[:0]
        if len(maybe):
            here = maybe + 8 * low + step[maybe]
            here += _extra((packed[maybe] >> 4).astype(np.int64) - 256)
            prefix, length = distance_code(here)
            step[maybe] = here + length + _extra(prefix) - maybe - 8 * low
        end = len(step)
        each, step = np.arange(end), np.append(step, _REST)
        two = step[:end] + step[each + step[:end]]  # two codes, and four, in one step
        steps = (two + np.append(two, _REST)[each + two]).tobytes()
        k, found = at - 8 * low, []
        note = found.append
        while k < end:
            note(k)
            k += steps[k]
        place = np.zeros((len(found), 4), np.int64)
        place[:, 0] = found
        for j in (1, 2, 3):
            place[:, j] = place[:, j - 1] + step[place[:, j - 1]]
        place = place[(place < end) & (np.diff(place, axis=1, prepend=-1) > 0)]
        at = 8 * low + int(place[-1]) + int(step[place[-1]])
        code_size = (packed[place] & 15).astype(np.int64)
        got = (packed[place] >> 4).astype(np.int64)
        counts = np.ones(len(got), np.int64)
        copies = np.flatnonzero(got > 255)
        if len(copies):
            counts[copies] = number(got[copies] - 256, place[copies] + 8 * low + code_size[copies])
        total = np.cumsum(counts)
        if made + int(total[-1]) >= n:
            use = int(np.searchsorted(total, n - made)) + 1
            if made + int(total[use - 1]) > n:
                raise Broken("a reference leaves the image")
            at = 8 * low + int(place[use - 1]) + int(step[place[use - 1]])
            got, counts, total, place, copies = got[:use], counts[:use], total[:use], place[:use], copies[copies < use]
        far_at = np.zeros(0, np.int64)
        if len(copies):
            p = place[copies] + 8 * low + code_size[copies] + _extra(got[copies] - 256)
            prefix, length = distance_code(p)
            far_at = number(prefix, p + length)
        parts.append((got, counts, made + total - counts, copies, far_at))
        made += int(total[-1])
    if at > 8 * size:
        raise Broken("the data end early")
    bits.at = at
    out = np.zeros(n, np.uint8)
    for got, _, begin, _, _ in parts:
        alone = got < 256
        out[begin[alone]] = got[alone]
    if any(len(p[3]) for p in parts):
        pixels = bytearray(out.tobytes())
        for _, counts, begin, copies, far_at in parts:
            for a, c, d in zip(begin[copies].tolist(), counts[copies].tolist(), far_at.tolist()):
                if d > 120:
                    d -= 120
                else:
                    x, y = _NEAR[d - 1]
                    d = max(1, x + y * width)
                if d > a:
                    raise Broken("a reference leaves the image")
                if d >= c:
                    pixels[a : a + c] = pixels[a - d : a - d + c]
                else:
                    pixels[a : a + c] = (bytes(pixels[a - d : a]) * (c // d + 1))[:c]
        out = np.frombuffer(pixels, np.uint8)
    return out


def _split(p: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(p, "<u4").view(np.uint8).reshape(*p.shape, 4).astype(np.int32)  # blue, green, red, alpha


def _joined(c: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(c.astype(np.uint8)).view("<u4")[..., 0].astype(np.uint32)


def _predict(mode: int, left: list, top: list, right: list, corner: list) -> list:
    """The prediction for each channel from the neighbours."""
    avg = lambda x, y: [(a + b) >> 1 for a, b in zip(x, y)]
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, corner))
        to_top = sum(abs(x - c) for x, c in zip(left, corner))
        return left if to_left < to_top else top
    if mode == 12:
        return [min(255, max(0, a + b - c)) for a, b, c in zip(left, top, corner)]
    if mode == 13:
        half = lambda x, c: min(255, max(0, x + int((x - c) / 2)))
        return [half(x, c) for x, c in zip(avg(left, top), corner)]
    return (lambda: [0, 0, 0, 255], lambda: left, lambda: top, lambda: right, lambda: corner, lambda: avg(avg(left, right), top), lambda: avg(left, corner),
            lambda: avg(left, top), lambda: avg(corner, top), lambda: avg(top, right), lambda: avg(avg(left, corner), avg(top, right)))[mode]()


def _predictor(p: np.ndarray, modes: np.ndarray, bits: int, sign: int) -> np.ndarray:
    """Adds predictions to residuals (sign 1), or takes them from pixels (sign -1)."""
    h, w = p.shape
    given = _split(p).tolist()
    out = [[None] * w for _ in range(h)]
    for y in range(h):
        for x in range(w):
            done = out if sign > 0 else given
            if not y:
                guess = done[0][x - 1] if x else [0, 0, 0, 255]
            elif not x:
                guess = done[y - 1][0]
            else:
                right = done[y - 1][x + 1] if x + 1 < w else done[y][0]
                guess = _predict(int(modes[y >> bits, x >> bits]) >> 8 & 15, done[y][x - 1], done[y - 1][x], right, done[y - 1][x - 1])
            out[y][x] = [(a + sign * b) & 255 for a, b in zip(given[y][x], guess)]
    return _joined(np.array(out))


def _cross_colour(p: np.ndarray, blocks: np.ndarray, bits: int, sign: int) -> np.ndarray:
    h, w = p.shape
    c = _split(p)
    by = _split(blocks)[np.arange(h)[:, None] >> bits, np.arange(w)[None, :] >> bits]
    signed = lambda x: ((x & 255) ^ 128) - 128
    delta = lambda t, x: signed(t) * signed(x) >> 5
    blue, green, red = c[..., 0], c[..., 1], c[..., 2]
    changed = (red + sign * delta(by[..., 0], green)) & 255
    true_red = changed if sign > 0 else red
    c[..., 0] = (blue + sign * (delta(by[..., 1], green) + delta(by[..., 2], true_red))) & 255
    c[..., 2] = changed
    return _joined(c)


def _subtract_green(p: np.ndarray, sign: int) -> np.ndarray:
    c = _split(p)
    c[..., 0] = (c[..., 0] + sign * c[..., 1]) & 255
    c[..., 2] = (c[..., 2] + sign * c[..., 1]) & 255
    return _joined(c)


def _bundle(colours: int) -> int:
    """Pixels to the power of two that one holds."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def decode(data: bytes) -> np.ndarray:
    """The pixels (height x width) of a lossless WebP file."""
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise Broken("not a WebP file")
    at = 12
    while data[at : at + 4] != b"VP8L":
        if at + 8 > len(data):
            raise Broken("no lossless image")
        at += 8 + struct.unpack_from("<I", data, at + 4)[0] + 1 & ~1
    size = struct.unpack_from("<I", data, at + 4)[0]
    bits = Bits(data[at + 8 : at + 8 + size])
    if bits.read(8) != 0x2F:
        raise Broken("the signature is missing")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise Broken("the version is unknown")
    todo, seen, full = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise Broken("a transform comes twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            b = bits.read(3) + 2
            w, h = -(-width >> b), -(-height >> b)
            todo.append((kind, _image(bits, w, h, False).reshape(h, w), b))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            table = _joined(np.cumsum(_split(_image(bits, n, 1, False)), axis=0) & 255)
            todo.append((kind, table, width))
            width = -(-width >> _bundle(n))
        else:
            todo.append((kind, None, 0))
    p = _image(bits, width, height, True).reshape(height, width)
    for kind, what, b in reversed(todo):
        if kind == PREDICTOR:
            p = _predictor(p, what, b, 1)
        elif kind == CROSS_COLOUR:
            p = _cross_colour(p, what, b, 1)
        elif kind == SUBTRACT_GREEN:
            p = _subtract_green(p, 1)
        else:
            k = _bundle(len(what))
            index = (p >> 8) & 255
            if k:
                each = 8 >> k
                index = (index[:, :, None] >> (np.arange(1 << k, dtype=np.uint32) * each)) & ((1 << each) - 1)
                index = index.reshape(height, -1)[:, :b]
            p = np.append(what, np.zeros(256, np.uint32))[index]
    if p.shape != (height, full):
        raise Broken("the sizes don't agree")
    return p


class _Writer:
    def __init__(self):
        self.value, self.at, self.out = 0, 0, bytearray()

    def put(self, x: int, n: int) -> None:
        self.value |= x << self.at
        self.at += n
        if self.at >= 512:
            k = self.at // 8
            self.out += (self.value & ((1 << 8 * k) - 1)).to_bytes(k, "little")
            self.value >>= 8 * k
            self.at -= 8 * k

    def put_array(self, bits: np.ndarray) -> None:
        """Bits one by one, from an array."""
        k = self.at // 8
        self.out += (self.value & ((1 << 8 * k) - 1)).to_bytes(k, "little")
        self.value, self.at = self.value >> 8 * k, self.at - 8 * k
        flat = np.concatenate([np.array([self.value >> k & 1 for k in range(self.at)], np.uint8), bits])
        made = np.packbits(flat, bitorder="little").tobytes()
        self.at = len(flat) % 8
        self.value = made[-1] if self.at else 0
        self.out += made[:-1] if self.at else made

    def done(self) -> bytes:
        return bytes(self.out) + self.value.to_bytes(-(-self.at // 8), "little")


def huffman(count: dict[int, int], most: int = 15) -> dict[int, int]:
    """Code lengths of at most ``most`` bits, by symbol; rare symbols are told as more frequent until they fit."""
    while True:
        order = sorted(count, key=lambda s: (count[s], s))
        n = len(order)
        if n < 2:
            return dict.fromkeys(order, 1)
        weight, above = [count[s] for s in order], [0] * (2 * n - 1)
        leaf, node = 0, n  # the next of either, lightest first
        for made in range(n, 2 * n - 1):
            total = 0
            for _ in (0, 1):
                if leaf < n and (node >= made or weight[leaf] <= weight[node]):
                    k, leaf = leaf, leaf + 1
                else:
                    k, node = node, node + 1
                above[k] = made
                total += weight[k]
            weight.append(total)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[above[k]] + 1
        if depth[0] <= most:
            return dict(zip(order, depth))
        least = max(1, weight[-1] >> most)
        count = {s: max(x + 1, least) if x < 4 * least else x for s, x in count.items()}


def _runs(lengths: dict[int, int], size: int) -> list[tuple[int, int, int]]:
    """Code lengths as (symbol, number of extra bits, extra bits), repeats told as runs."""
    out: list = []

    def told(n: int, run: int) -> None:
        if n:
            out.append((n, 0, 0))
            run -= 1
        while run >= 3:
            t = min(run, 6 if n else 138)
            out.append((16, 2, t - 3) if n else (18, 7, t - 11) if t > 10 else (17, 3, t - 3))
            run -= t
        out.extend([(n, 0, 0)] * run)

    done, last, run = 0, 0, 0
    for s in sorted(lengths):
        if s > done or lengths[s] != last:
            if run:
                told(last, run)
            if s > done:
                told(0, s - done)
            last, run = lengths[s], 0
        run += 1
        done = s + 1
    if run:
        told(last, run)
    if done < size:
        told(0, size - done)
    return out


def _write_code(out: _Writer, lengths: dict[int, int], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Writes a code; its symbols, and what to put for each and in how many bits."""
    used = sorted(lengths) or [0]
    if len(used) <= 2 and used[-1] < 256:
        if used == [0]:
            out.put(1, 4)
        else:
            out.put(1 | len(used) - 1 << 1 | 1 << 2, 3)
            for s in used:
                out.put(s, 8)
    else:
        out.put(0, 1)
        told = _runs(lengths, size)
        own = huffman(Counter(s for s, _, _ in told), 7)
        codes = dict(zip(*(x.tolist() for x in _canonical(own)[:2])))
        last = max(k for k, s in enumerate(_LENGTH_ORDER) if s in own)
        out.put(max(0, last - 3), 4)
        for s in _LENGTH_ORDER[: max(4, last + 1)]:
            out.put(own.get(s, 0), 3)
        out.put(0, 1)
        alone = len(own) == 1
        for s, n, extra in told:
            wide = 0 if alone else own[s]
            out.put((0 if alone else codes[s]) | extra << wide, wide + n)
    if len(used) == 1:
        return np.array(used), np.zeros(1, np.int64), np.zeros(1, np.int64)
    return _canonical(lengths)


def _prefix(x: int) -> tuple[int, int, int]:
    """A length or distance code as (prefix, number of extra bits, extra bits)."""
    if x <= 4:
        return x - 1, 0, 0
    x -= 1
    top = x.bit_length() - 1
    second = x >> (top - 1) & 1
    return 2 * top + second, top - 1, x & ((1 << (top - 1)) - 1)


def _tokens(p: list[int], cache_bits: int, references: bool) -> list[tuple]:
    """Literals, cache hits and copies for some pixels."""
    out, at, seen, cache = [], 0, {}, {}

    def enter(k: int) -> None:
        if cache_bits:
            cache[0x1E35A7BD * p[k] % (1 << 32) >> 32 - cache_bits] = p[k]
        if references and k + 2 < len(p):
            seen[p[k], p[k + 1], p[k + 2]] = k

    while at < len(p):
        n, from_ = 0, seen.get(tuple(p[at : at + 3])) if references else None
        if from_ is not None:
            while at + n < len(p) and n < 4096 and p[from_ + n] == p[at + n]:
                n += 1
        if n >= 3:
            out.append(("copy", n, at - from_ + 120))
        else:
            key = 0x1E35A7BD * p[at] % (1 << 32) >> 32 - cache_bits if cache_bits else None
            out.append(("cache", key) if key is not None and cache.get(key, 0) == p[at] else ("pixel", p[at]))
            n = 1
        for k in range(at, at + n):
            enter(k)
        at += n
    return out


def _write_image(out: _Writer, p: np.ndarray, main: bool, cache_bits: int = 0, references: bool = False, meta: np.ndarray | None = None, meta_bits: int = 2) -> None:
    out.put(bool(cache_bits), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    height, width = p.shape
    if main:
        out.put(meta is not None, 1)
        if meta is not None:
            out.put(meta_bits - 2, 3)
            _write_image(out, meta.astype(np.uint32) << 8, False)
    tokens, at, by = _tokens(p.ravel().tolist(), cache_bits, references), 0, []
    for t in tokens:
        by.append(int(meta[at // width >> meta_bits, at % width >> meta_bits]) if meta is not None else 0)
        at += t[1] if t[0] == "copy" else 1
    counts = [[Counter() for _ in range(5)] for _ in range(max([0, *(meta.ravel().tolist() if meta is not None else [])]) + 1)]

    def symbols(t: tuple) -> list[tuple[int, int, int, int]]:
        """(code, symbol, extra bits' number and value)"""
        if t[0] == "cache":
            return [(0, 280 + t[1], 0, 0)]
        if t[0] == "copy":
            a, b = _prefix(t[1]), _prefix(t[2])
            return [(0, 256 + a[0], a[1], a[2]), (4, b[0], b[1], b[2])]
        v = t[1]
        return [(0, v >> 8 & 255, 0, 0), (1, v >> 16 & 255, 0, 0), (2, v & 255, 0, 0), (3, v >> 24, 0, 0)]

    for g, t in zip(by, tokens):
        for k, s, _, _ in symbols(t):
            counts[g][k][s] += 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    tell = lambda made: {s: (c, n) for s, c, n in zip(*(x.tolist() for x in made))}
    codes = [[tell(_write_code(out, huffman(c), n)) for c, n in zip(group, sizes)] for group in counts]
    for g, t in zip(by, tokens):
        for k, s, n, extra in symbols(t):
            out.put(*codes[g][k][s])
            out.put(extra, n)


def _file(body: bytes) -> bytes:
    pad = len(body) % 2
    return b"RIFF" + struct.pack("<I", 12 + len(body) + pad) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + b"\0" * pad


def _head(width: int, height: int) -> _Writer:
    if not (0 < width <= SIDE and 0 < height <= SIDE):
        raise ValueError(f"sides must be from 1 to {SIDE}")
    out = _Writer()
    for x, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.put(x, n)
    return out


def encode(p: np.ndarray, transforms: list[tuple] = (), cache_bits: int = 0, references: bool = False, meta: np.ndarray | None = None, meta_bits: int = 2) -> bytes:
    """A lossless WebP file of pixels (height x width), with the given transforms in order:
    (PREDICTOR, modes by block, bits), (CROSS_COLOUR, elements by block, bits), (SUBTRACT_GREEN,), (PALETTE,)."""
    p = np.asarray(p, np.uint32)
    out = _head(p.shape[1], p.shape[0])
    for kind, *what in transforms:
        out.put(1, 1)
        out.put(kind, 2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            blocks, bits = np.asarray(what[0], np.uint32), what[1]
            out.put(bits - 2, 3)
            if kind == PREDICTOR:
                blocks = blocks << 8
            _write_image(out, blocks, False)
            p = (_predictor if kind == PREDICTOR else _cross_colour)(p, blocks, bits, -1)
        elif kind == SUBTRACT_GREEN:
            p = _subtract_green(p, -1)
        else:
            table, index = np.unique(p, return_inverse=True)
            index = index.reshape(p.shape).astype(np.uint32)
            if len(table) > 256:
                raise ValueError("a palette has 256 colours at most")
            out.put(len(table) - 1, 8)
            steps = _split(table)
            steps[1:] = (steps[1:] - steps[:-1]) & 255
            _write_image(out, _joined(steps)[None, :], False)
            k = _bundle(len(table))
            if k:
                index = np.pad(index, ((0, 0), (0, -p.shape[1] % (1 << k)))).reshape(p.shape[0], -1, 1 << k)
                index = (index << (np.arange(1 << k, dtype=np.uint32) * (8 >> k))).sum(2).astype(np.uint32)
            p = index << 8 | np.uint32(_BLACK)
    out.put(0, 1)
    _write_image(out, p, True, cache_bits, references, meta, meta_bits)
    return _file(out.done())


def _copies(flat: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Where copies begin, how long they are and how far back: of each place with LEAST_COPY bytes that
    came before the latest such place, greedily from the front."""
    n = len(flat) - LEAST_COPY + 1
    if n <= 1:
        return [], [], []
    data = flat.tobytes()
    key = np.ndarray((n,), "<u8", data, 0, (1,))
    # by 16 bits of a hash, which are sorted in linear time; of those that share them, equal neighbours count
    order = np.argsort((key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.uint16), kind="stable")
    sorted_ = key[order]
    same = np.flatnonzero(sorted_[1:] == sorted_[:-1])
    if not len(same):
        return [], [], []
    before = np.full(n, -1, np.int64)
    before[order[same + 1]] = order[same]
    places = np.flatnonzero(before >= 0).tolist()
    begin, count, back = [], [], []
    k, size = 0, len(data)
    while k < len(places):
        at = places[k]
        q = int(before[at])
        c, most = LEAST_COPY, min(MOST_COPY, size - at)
        while c + 32 <= most and data[at + c : at + c + 32] == data[q + c : q + c + 32]:
            c += 32
        for more in (16, 8, 4, 2, 1):
            if c + more <= most and data[at + c : at + c + more] == data[q + c : q + c + more]:
                c += more
        begin.append(at)
        count.append(c)
        back.append(at - q)
        k = bisect_left(places, at + c, k)
    return begin, count, back


@lru_cache
def _prefix_table() -> np.ndarray:
    return np.stack(_made_prefixes(np.arange(1 << 15)))


def _prefixes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_prefix`` of each number."""
    return tuple(_prefix_table()[:, x]) if int(x.max()) < 1 << 15 else _made_prefixes(x)


def _made_prefixes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = np.maximum(x - 1, 0)
    top = np.maximum(np.frexp(np.maximum(v, 1).astype(float))[1] - 1, 1)
    small = v < 4
    more = np.where(small, 0, top - 1)
    return np.where(small, v, 2 * top + (v >> (top - 1) & 1)), more, np.where(small, 0, v & ((1 << more) - 1))


def _write_green(out: _Writer, flat: np.ndarray) -> None:
    """The codes and pixels of an image whose green channel alone varies: literals and copies."""
    for x, n in ((0, 1), (0, 1)):  # no colour cache, one group of codes
        out.put(x, n)
    begin, count, back = _copies(flat)
    if begin:
        b, c, d = (np.array(x, np.int64) for x in (begin, count, back))
        cover = np.zeros(len(flat) + 1, np.int8)
        cover[b] += 1
        cover[b + c] -= 1
        alone = np.cumsum(cover[:-1]) == 0
        alone[b] = True
        place = np.flatnonzero(alone)
        symbol = flat[place].astype(np.int64)
        at = np.searchsorted(place, b)
        prefix, len_bits, len_extra = _prefixes(c)
        symbol[at] = 256 + prefix
        far, far_bits, far_extra = _prefixes(d + 120)
    else:
        symbol, far = flat.astype(np.int64), np.zeros(0, np.int64)
    def code(symbols: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        n = np.bincount(symbols, minlength=size)
        used = np.flatnonzero(n)
        table = np.zeros((2, size), np.uint64)
        of, codes, bits = _write_code(out, huffman(dict(zip(used.tolist(), n[used].tolist()))), size)
        table[0, of], table[1, of] = codes, bits
        return table[0][symbols], table[1][symbols]

    value, bits = code(symbol, 280)
    for lone in (0, 0, 255):  # red, blue, alpha
        _write_code(out, {lone: 1}, 256)
    far_code, far_size = code(far, 40)
    if len(far):
        for x, n in ((len_extra, len_bits), (far_code, far_size), (far_extra, far_bits)):
            value[at] |= x.astype(np.uint64) << bits[at]
            bits[at] += n.astype(np.uint64)
    for k in range(0, len(value), BLOCK):
        v, n = value[k : k + BLOCK], bits[k : k + BLOCK].astype(np.int64)
        total = int(n.sum())
        if total:
            inside = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
            out.put_array((np.repeat(v, n) >> inside.astype(np.uint64)).astype(np.uint8) & 1)


def encode_samples(samples: np.ndarray) -> bytes:
    """A lossless WebP file of 8-bit samples (height x width) in the green channel.

    Literals and copies of earlier stretches have prefix codes by their frequency.  If 2 to 16
    values occur, a palette holds them and a pixel packs several.
    """
    height, width = samples.shape
    out = _head(width, height)
    used = np.flatnonzero(np.bincount(samples.ravel(), minlength=256))
    if 1 < len(used) <= 16:
        table = used.astype(np.uint32) << 8 | np.uint32(_BLACK)
        out.put(1, 1)
        out.put(PALETTE, 2)
        out.put(len(used) - 1, 8)
        steps = _split(table)
        steps[1:] = (steps[1:] - steps[:-1]) & 255
        _write_image(out, _joined(steps)[None, :], False)
        k = _bundle(len(used))
        index = np.searchsorted(used, samples).astype(np.uint8)
        index = np.pad(index, ((0, 0), (0, -width % (1 << k)))).reshape(height, -1, 1 << k)
        samples = (index << (np.arange(1 << k, dtype=np.uint8) * np.uint8(8 >> k))).sum(2, dtype=np.uint8)
    out.put(0, 1)
    _write_green(out, samples.ravel())
    return _file(out.done())
