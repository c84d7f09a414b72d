"""Media columns (operator 5): lossless WebP.

`decode` reads any still lossless file: simple and normal prefix codes, meta prefix groups, back-references, colour
cache, and the predictor, cross-colour, subtract-green and palette transforms, inverted in reverse order.  `decode_many`
reads many files side by side, one symbol of each at a step, with all of these but meta prefix groups, for which it
calls `decode`.  `encode` writes an image with given transforms; `pack_many` chooses for each image what it gains by:
a palette, a predictor, or cross-colour, then back-references to earlier pixels, a colour cache, and the cheapest of a
few prefix codes.  Choices depend on the image alone, so equal texts give equal files.

A payload is a text's UTF-8 bytes (null: none) filled with 255 up to a positive multiple of 576: the green, red, blue
and alpha samples of 144 pixels a row.  Payloads beyond what one image holds are stored as several images one after
another, each a file of its own.  Repeated rows, ties and clashing names change nothing, as each row stands alone; texts
are packed and read in groups of some MB, and a longer text is alone in its group and takes some 60 times its size.
Other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import flat, gathered, mix, prepare

ROW = 576
CODES = (280, 256, 256, 256, 40)  # alphabets of green with lengths, red, blue, alpha, distance
#: The order in which the lengths of the code length code are stored (fixed values of the format).
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_FACTOR = 0x1E35A7BD
#: Offsets of short distance codes: nearest first, then lower rows first, then right before left.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, -p[1], -p[0]))


class Bits:
    """Reads little-endian bit fields."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data + b"\0" * 8, at
        self.end = len(data) * 8

    def peek(self, n: int) -> int:
        i = self.at >> 3
        return int.from_bytes(self.data[i : i + 8], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        x = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise ValueError("the stream ends early")
        return x


class Writer:
    def __init__(self):
        self.value, self.n = 0, 0
        self.parts: list[bytes] = []

    def put(self, x: int, n: int) -> None:
        self.value |= x << self.n
        self.n += n
        if self.n >= 4096:
            whole = self.n >> 3
            self.parts.append((self.value & ((1 << 8 * whole) - 1)).to_bytes(whole, "little"))
            self.value, self.n = self.value >> 8 * whole, self.n & 7

    def done(self) -> bytes:
        return b"".join(self.parts) + self.value.to_bytes((self.n + 7) >> 3, "little")


# Prefix codes


def code_lengths(counts: list[int], longest: int) -> list[int]:
    """Lengths of a prefix code of at most `longest` bits; counts are levelled until it fits."""
    used = [s for s, n in enumerate(counts) if n]
    out = [0] * len(counts)
    if len(used) < 2:
        for s in used:
            out[s] = 1
        return out
    floor = 1
    while True:
        heap = [(max(counts[s], floor), s, (s,)) for s in used]
        heapq.heapify(heap)
        depth = dict.fromkeys(used, 0)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(depth.values()) <= longest:
            for s, n in depth.items():
                out[s] = n
            return out
        floor *= 2


def canonical(lengths) -> dict[int, tuple[int, int]]:
    """(bits as stored, length) of each symbol."""
    out, code, before = {}, 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - before
        out[s] = int(f"{code:0{n}b}"[::-1], 2), n
        code, before = code + 1, n
    return out


class Code:
    """A decoding table: by the next `width` bits, symbol and length."""

    def __init__(self, lengths: list[int]):
        used = [s for s, n in enumerate(lengths) if n]
        self.width = max([0, *lengths])
        self.symbols, self.lengths = np.zeros(1 << self.width, np.int32), np.zeros(1 << self.width, np.int32)
        if len(used) == 1:  # a code of one symbol takes no bits
            self.width, self.symbols, self.lengths = 0, np.array(used, np.int32), np.zeros(1, np.int32)
        else:
            if used and sum(2.0**-n for n in lengths if n) != 1:
                raise ValueError("an incomplete prefix code")
            for s, (bits, n) in canonical(lengths).items():
                self.symbols[bits :: 1 << n], self.lengths[bits :: 1 << n] = s, n
        self.pairs = list(zip(self.symbols.tolist(), self.lengths.tolist()))

    def read(self, bits: Bits) -> int:
        s, n = self.pairs[bits.peek(self.width)]
        bits.at += n
        return s


def read_code(bits: Bits, size: int) -> Code:
    lengths = [0] * size
    if bits.read(1):
        two = bits.read(1)
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    own = [0] * 19
    for i in range(4 + bits.read(4)):
        own[LENGTH_ORDER[i]] = bits.read(3)
    tokens = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    code, at, before = Code(own), 0, 8
    while at < size and tokens:
        tokens -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            at += 1
            before = s or before
        else:
            n = 3 + bits.read(2) if s == 16 else 3 + bits.read(3) if s == 17 else 11 + bits.read(7)
            if at + n > size:
                raise ValueError("a code length beyond the alphabet")
            if s == 16:
                lengths[at : at + n] = [before] * n
            at += n
    return Code(lengths)


def write_code(out: Writer, lengths: list[int]) -> None:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        out.put(1, 1)
        out.put(len(used) - 1, 1)
        out.put(1, 1)
        for s in used:
            out.put(s, 8)
        return
    tokens, i = [], 0
    while i < len(lengths):
        n = 1
        while i + n < len(lengths) and lengths[i + n] == lengths[i] and n < 138:
            n += 1
        if lengths[i] == 0 and n >= 3:
            tokens.append((17, n - 3, 3) if n < 11 else (18, n - 11, 7))
        elif lengths[i] and n >= 4:
            n = min(n, 7)
            tokens += [(lengths[i], 0, 0), (16, n - 4, 2)]
        else:
            n = 1
            tokens.append((lengths[i], 0, 0))
        i += n
    counts = [0] * 19
    for t, _, _ in tokens:
        counts[t] += 1
    own = code_lengths(counts, 7)
    out.put(0, 1)
    out.put(15, 4)
    for s in LENGTH_ORDER:
        out.put(own[s], 3)
    out.put(0, 1)
    codes = canonical(own) if sum(map(bool, own)) > 1 else {tokens[0][0]: (0, 0)}
    for t, extra, n in tokens:
        out.put(*codes[t])
        out.put(extra, n)


# Entropy-coded images of ARGB values


def _prefixed(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits and their number, of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    n = v.bit_length() - 2
    return 2 * (n + 1) + (v >> n & 1), v & ((1 << n) - 1), n


def _value(symbol: int, bits: Bits) -> int:
    if symbol < 4:
        return symbol + 1
    n = symbol - 2 >> 1
    return (2 + (symbol & 1) << n) + bits.read(n) + 1


def read_image(bits: Bits, width: int, height: int, main: bool) -> list[int]:
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("a colour cache of over 11 bits")
    groups_of, group_bits, blocks = None, 0, 0
    if main and bits.read(1):
        group_bits = bits.read(3) + 2
        blocks = (width + (1 << group_bits) - 1) >> group_bits
        groups_of = [p >> 8 & 0xFFFF for p in read_image(bits, blocks, (height + (1 << group_bits) - 1) >> group_bits, False)]
    cache, shift = [0] * (1 << cache_bits) if cache_bits else [], 32 - cache_bits
    groups = [[read_code(bits, n + (i == 0 and len(cache))) for i, n in enumerate(CODES)] for _ in range(max(groups_of) + 1 if groups_of else 1)]
    out, total = [], width * height
    group = groups[0]
    while (at := len(out)) < total:
        if groups_of:
            y, x = divmod(at, width)
            group = groups[groups_of[(y >> group_bits) * blocks + (x >> group_bits)]]
        s = group[0].read(bits)
        if s < 256:
            red, blue = group[1].read(bits), group[2].read(bits)
            new = [group[3].read(bits) << 24 | red << 16 | s << 8 | blue]
        elif s < 280:
            n, d = _value(s - 256, bits), _value(group[4].read(bits), bits)
            if d > 120:
                d -= 120
            else:
                dx, dy = NEAR[d - 1]
                d = max(1, dx + dy * width)
            if d > at or at + n > total:
                raise ValueError("a back-reference outside the image")
            new = (out[at - d : at - d + n] * (n // d + 1))[:n] if d < n else out[at - d : at - d + n]
        else:
            new = [cache[s - 280]]
        if cache_bits:
            for p in new:
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> shift] = p
        out += new
        if bits.at > bits.end:
            raise ValueError("the stream ends early")
    return out


def write_image(out: Writer, pixels: list[int], width: int, main: bool, cache_bits: int = 0, references: bool = False) -> None:
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    cache, shift = {}, 32 - cache_bits
    near = {d: i for i, (x, y) in reversed([*enumerate(NEAR, 1)]) if (d := x + y * width) >= 1}
    seen: dict[tuple, int] = {}
    symbols, at = [], 0

    def remember(i):
        if cache_bits:
            cache[(CACHE_FACTOR * pixels[i] & 0xFFFFFFFF) >> shift] = pixels[i]
        if references and i >= 2:
            seen[tuple(pixels[i - 2 : i + 1])] = i - 2

    while at < len(pixels):
        n = 0
        if references and (start := seen.get(tuple(pixels[at : at + 3]), at)) < at:
            while at + n < len(pixels) and n < 4096 and pixels[start + n] == pixels[at + n]:
                n += 1
        if n >= 3:
            d = at - start
            symbols.append((n, near.get(d, d + 120)))
        else:
            n, p = 1, pixels[at]
            k = (CACHE_FACTOR * p & 0xFFFFFFFF) >> shift if cache_bits else -1
            symbols.append((280 + k,) if cache_bits and cache.get(k) == p else (p >> 8 & 255, p >> 16 & 255, p & 255, p >> 24))
        for i in range(at, at + n):
            remember(i)
        at += n
    counts = [[0] * (c + (i == 0 and (1 << cache_bits if cache_bits else 0))) for i, c in enumerate(CODES)]
    fields = []
    for s in symbols:
        if len(s) == 2:
            a, b = _prefixed(s[0]), _prefixed(s[1])
            s = [(0, 256 + a[0], *a[1:]), (4, *b)]
        else:
            s = [(i, x, 0, 0) for i, x in enumerate(s)]
        for i, x, _, _ in s:
            counts[i][x] += 1
        fields += s
    codes = []
    for c in counts:
        lengths = code_lengths(c, 15)
        if sum(map(bool, lengths)) == 1 and lengths.index(1) >= 256:  # only symbols below 256 have the simple form
            lengths[0] = 1
        write_code(out, lengths)
        codes.append(canonical(lengths) if sum(map(bool, lengths)) > 1 else {lengths.index(1) if any(lengths) else 0: (0, 0)})
    for i, x, extra, n in fields:
        out.put(*codes[i][x])
        out.put(extra, n)


# Transforms; pixels are arrays (height, width, 4) of A, R, G, B


def split(pixels) -> np.ndarray:
    return np.array(pixels, np.uint32).astype(">u4").view(np.uint8).reshape(-1, 4)


def joined(samples: np.ndarray) -> list[int]:
    return np.ascontiguousarray(samples, np.uint8).reshape(-1, 4).view(">u4").ravel().astype(np.uint32).tolist()


def _average(a, b):
    return (a + b) >> 1


def _select(left, top, corner):
    to_left, to_top = np.abs(top - corner).sum(-1), np.abs(left - corner).sum(-1)
    return left if to_left < to_top else top


def _clamp(x):
    return np.clip(x, 0, 255)


def predicted(mode: int, left, top, right, corner):
    """The prediction from the four neighbours; integer arrays of 4 samples."""
    if mode == 0 or mode > 13:
        return np.array([255, 0, 0, 0])
    if mode == 13:
        a = _average(left, top)
        return _clamp(a + np.trunc((a - corner) / 2).astype(np.int64))
    return (
        None,
        lambda: left,
        lambda: top,
        lambda: right,
        lambda: corner,
        lambda: _average(_average(left, right), top),
        lambda: _average(left, corner),
        lambda: _average(left, top),
        lambda: _average(corner, top),
        lambda: _average(top, right),
        lambda: _average(_average(left, corner), _average(top, right)),
        lambda: _select(left, top, corner),
        lambda: _clamp(left + top - corner),
    )[mode]()


def predict(image: np.ndarray, modes: list[int], bits: int, back: bool) -> np.ndarray:
    """Residuals of an image, or with `back` the image of its residuals."""
    h, w, _ = image.shape
    blocks, out = (w + (1 << bits) - 1) >> bits, image.astype(np.int64)
    whole = out if back else image.astype(np.int64)
    for y in range(h):
        for x in range(w):
            if y == 0 or x == 0:
                p = whole[0, x - 1] if x else whole[y - 1, 0] if y else np.array([255, 0, 0, 0])
            else:
                right = whole[y - 1, x + 1] if x + 1 < w else whole[y, 0]  # the next pixel in memory
                p = predicted(modes[(y >> bits) * blocks + (x >> bits)], whole[y, x - 1], whole[y - 1, x], right, whole[y - 1, x - 1])
            out[y, x] = (out[y, x] + p if back else whole[y, x] - p) & 255
    return out.astype(np.uint8)


def cross_colour(image: np.ndarray, elements: np.ndarray, bits: int, back: bool) -> np.ndarray:
    """elements: (rows, blocks, 3) signed green to red, green to blue, red to blue."""
    h, w, _ = image.shape
    e = elements.astype(np.int8).astype(np.int64)[np.arange(h)[:, None] >> bits, np.arange(w)[None] >> bits]
    out = image.astype(np.int64)
    red, green = out[..., 1], signed(out[..., 2])
    new = red + (1 if back else -1) * (e[..., 0] * green >> 5)
    seen = signed((new if back else red) & 255)
    change = (e[..., 1] * green >> 5) + (e[..., 2] * seen >> 5)
    out[..., 3] += change if back else -change
    out[..., 1] = new
    return (out & 255).astype(np.uint8)


def green(image: np.ndarray, back: bool) -> np.ndarray:
    out = image.copy()
    for c in (1, 3):
        out[..., c] = image[..., c] + image[..., 2] if back else image[..., c] - image[..., 2]
    return out


def _palette_bits(n: int) -> int:
    return 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0


def encode(image: np.ndarray, transforms=(), cache_bits: int = 0, references: bool = False) -> bytes:
    """A lossless file of an array (height, width, 4) of A, R, G, B.

    transforms: ("predict", modes, bits), ("cross", elements, bits), ("green",), ("palette",), in this order of use.
    """
    h, w, _ = image.shape
    out = Writer()
    out.put(0x2F, 8)
    out.put(w - 1, 14)
    out.put(h - 1, 14)
    out.put(int((image[..., 0] != 255).any()), 1)
    out.put(0, 3)
    now = image
    for kind, *args in transforms:
        out.put(1, 1)
        if kind == "predict":
            modes, bits = args
            out.put(0, 2)
            out.put(bits - 2, 3)
            write_image(out, [0xFF000000 | m << 8 for m in modes], (now.shape[1] + (1 << bits) - 1) >> bits, False)
            now = predict(now, modes, bits, False)
        elif kind == "cross":
            elements, bits = args
            out.put(1, 2)
            out.put(bits - 2, 3)
            e = np.asarray(elements).astype(np.int8).view(np.uint8).astype(np.uint32).reshape(-1, 3)
            write_image(out, (0xFF000000 | e[:, 2] << 16 | e[:, 1] << 8 | e[:, 0]).tolist(), elements.shape[1], False)
            now = cross_colour(now, elements, bits, False)
        elif kind == "green":
            out.put(2, 2)
            now = green(now, False)
        else:
            now = _to_palette(now, out)
    out.put(0, 1)
    write_image(out, joined(now), now.shape[1], True, cache_bits, references)
    return contained(out.done())


def _to_palette(image: np.ndarray, out: Writer) -> np.ndarray:
    """Write the palette of an image's colours, and give the image of packed indexes."""
    colours, index = np.unique(np.ascontiguousarray(image).view(">u4")[..., 0].astype(np.uint32), return_inverse=True)
    if len(colours) > 256:
        raise ValueError("a palette of over 256 colours")
    out.put(3, 2)
    out.put(len(colours) - 1, 8)
    write_image(out, joined(np.diff(split(colours), axis=0, prepend=np.zeros((1, 4), np.uint8))), len(colours), False)
    index, k = index.reshape(image.shape[:2]), _palette_bits(len(colours))
    index = np.pad(index, ((0, 0), (0, -index.shape[1] % (1 << k))))
    packed = sum(index[:, i :: 1 << k] << i * (8 >> k) for i in range(1 << k))
    now = np.zeros((*packed.shape, 4), np.uint8)
    now[..., 0], now[..., 2] = 255, packed
    return now


def contained(stream: bytes) -> bytes:
    """The RIFF file of a lossless stream."""
    body = stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + (len(body) + 12).to_bytes(4, "little") + b"WEBPVP8L" + len(stream).to_bytes(4, "little") + body


def stream_of(file: bytes) -> bytes:
    if file[:4] != b"RIFF" or file[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    n = int.from_bytes(file[16:20], "little")
    if len(file) < 20 + n:
        raise ValueError("the file ends early")
    return file[20 : 20 + n]


def head(bits: Bits) -> tuple[int, int]:
    if bits.read(8) != 0x2F:
        raise ValueError("no lossless signature")
    w, h = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    return w, h


def transforms_of(bits: Bits, w: int, h: int) -> tuple[list[tuple], int]:
    """The transforms of a stream, as (kind, data, block bits, width before), and the width that is left."""
    todo: list[tuple] = []
    while bits.read(1):
        kind = bits.read(2)
        if kind in [t[0] for t in todo]:
            raise ValueError("a transform twice")
        if kind < 2:
            k = bits.read(3) + 2
            blocks, rows = (w + (1 << k) - 1) >> k, (h + (1 << k) - 1) >> k
            data = split(read_image(bits, blocks, rows, False)).reshape(rows, blocks, 4)
            todo.append((kind, data[..., 2].ravel().tolist() if kind == 0 else data[..., 3:0:-1], k, w))
        elif kind == 2:
            todo.append((2, None, 0, w))
        else:
            n = bits.read(8) + 1
            table = np.cumsum(split(read_image(bits, n, 1, False)), axis=0, dtype=np.uint8)
            todo.append((3, table, _palette_bits(n), w))
            w = (w + (1 << todo[-1][2]) - 1) >> todo[-1][2]
    return todo, w


def restored(now: np.ndarray, todo: list[tuple]) -> np.ndarray:
    """The image before its transforms."""
    for kind, data, k, w in reversed(todo):
        if kind == 0:
            now = unpredicted(now, data, k)
        elif kind == 1:
            now = cross_colour(now, data, k, True)
        elif kind == 2:
            now = green(now, True)
        else:
            each, packed = 8 >> k, now[..., 2].astype(np.int64)
            index = np.stack([packed >> i * each & ((1 << each) - 1) for i in range(1 << k)], -1).reshape(len(now), -1)[:, :w]
            now = np.concatenate([data, np.zeros((256 - len(data), 4), np.uint8)])[index]
    return now


def unpredicted(residuals: np.ndarray, modes: list[int], bits: int) -> np.ndarray:
    """The image of its residuals; one mode throughout, of those that look at one neighbour, is a running sum."""
    if set(modes) not in ({1}, {2}):
        return predict(residuals, modes, bits, True)
    out = residuals.copy()
    out[0, 0, 0] = (int(out[0, 0, 0]) + 255) & 255  # opaque black stands before the first pixel
    out[0] = np.cumsum(out[0], 0, dtype=np.uint8)
    if modes[0] == 2:
        return np.cumsum(out, 0, dtype=np.uint8)
    out[:, 0] = np.cumsum(out[:, 0], 0, dtype=np.uint8)
    out[1:] = np.cumsum(out[1:], 1, dtype=np.uint8)
    return out


def residuals_of(image: np.ndarray, mode: int) -> np.ndarray:
    """What `unpredicted` sums up, for one mode (1: left, 2: top) throughout."""
    out = image.copy()
    if mode == 2:
        out[1:] -= image[:-1]
    else:
        out[:, 1:] -= image[:, :-1]
        out[1:, 0] -= image[:-1, 0]
    out[0, 1:] = image[0, 1:] - image[0, :-1]
    out[0, 0, 0] = (int(out[0, 0, 0]) - 255) & 255
    return out


def decode(file: bytes) -> np.ndarray:
    """The pixels (height, width, 4) of A, R, G, B."""
    bits = Bits(stream_of(file))
    width, h = head(bits)
    todo, w = transforms_of(bits, width, h)
    return restored(split(read_image(bits, w, h, True)).reshape(h, w, 4), todo)


# Payloads as images


#: Bits of the colour cache that files with one have, and the least and most pixels that a back-reference copies.
CACHE_BITS, LEAST_COPY, MOST_COPY = 8, 3, 4096


def _usual() -> np.ndarray:
    """Weights of bytes by a rough model of text: letters by rank, then other classes."""
    weight = np.ones(256, np.int64)
    weight[0x80:0xC0] = 8
    weight[[*range(0x41, 0x5B), *range(0x30, 0x3A), 0x2E, 0x2C, 0x0A, 0xC3, 0xFF]] = 16
    for rank, b in enumerate(b" etanoisrhldcumfpgwybvkxjqz"):
        weight[b] = int(1600 / (rank + 1.5)) + 8
    return weight


class Coding:
    """Prefix codes for literals of some weights, copies, and cached pixels: their stored form and each symbol's bits."""

    def __init__(self, weight: np.ndarray, cache: bool):
        total = int(weight.sum())
        copies = [max(1, total // 400)] * 24
        greens = [*weight.tolist(), *copies, *([max(1, total // 2000)] * (1 << CACHE_BITS) if cache else [])]
        self.cache = cache
        lengths = [code_lengths(greens, 13), *[code_lengths(weight.tolist(), 12)] * 3, code_lengths([1] * CODES[4], 6)]
        out = Writer()
        out.put(int(cache), 1)
        if cache:
            out.put(CACHE_BITS, 4)
        out.put(0, 1)  # no meta prefix codes
        self.bits, self.sizes = [], []
        for own in lengths:
            write_code(out, own)
            codes = canonical(own)
            self.bits.append(np.array([codes[s][0] for s in range(len(own))], np.uint64))
            self.sizes.append(np.array([codes[s][1] for s in range(len(own))], np.int64))
        self.head = (int.from_bytes(out.done(), "little"), sum(map(len, out.parts)) * 8 + out.n)


_codings: list[Coding] = []


def codings() -> list[Coding]:
    """By number: text, flat, residuals; each without and with a cache."""
    if not _codings:
        peaked = (4096 / (1 + np.minimum(np.arange(256), 256 - np.arange(256)) ** 2) + 1).astype(np.int64)
        _codings.extend(Coding(w, c) for w in (_usual(), np.full(256, 16), peaked) for c in (False, True))
    return _codings


def shapes_of(n: int) -> list[tuple[int, int]]:
    """Width and height of each image of `n` payload bytes, a multiple of ROW: as few images as hold it."""
    rows, most = n // ROW, 113 * 16384  # 113 x 144 pixels are the widest multiple that a file may have
    return [(144 * -(-r // 16384), -(-r // -(-r // 16384))) for r in (min(most, rows - lo) for lo in range(0, rows, most))]


def images_of(payload: np.ndarray) -> list[np.ndarray]:
    """The images (height, width, 4) of A, R, G, B that hold a payload, the last filled with 255."""
    out, at = [], 0
    for w, h in shapes_of(len(payload)):
        part = payload[at : at + 4 * w * h]
        at += len(part)
        part = np.concatenate([part, np.full(4 * w * h - len(part), 255, np.uint8)]).reshape(h, w, 4)
        out.append(part[..., (3, 1, 0, 2)])
    return out


#: Multipliers that cross-colour is tried with, in 32nds of green.
FACTORS = (32, -32, 16, 64)


def chosen_transform(image: np.ndarray) -> tuple | None:
    """The transform that makes most of an image's pixels repeat, if one does."""
    pixels = np.ascontiguousarray(image).view(">u4")[..., 0].astype(np.uint32)
    n = pixels.size
    if len(set(pixels[0].tolist())) <= 16 and len(np.unique(pixels)) <= 16:  # a row of more colours rules it out
        return ("palette",)
    # Equal steps from pixel to pixel leave equal residuals, which copies then take.
    steps = pixels[:, 1:] - pixels[:, :-1], pixels[1:] - pixels[:-1]
    even = np.count_nonzero(steps[0][:, 1:] == steps[0][:, :-1]), np.count_nonzero(steps[1][1:] == steps[1][:-1])
    mode = 1 if even[0] >= even[1] else 2
    if even[mode - 1] > n // 2 and np.count_nonzero(steps[mode - 1]) > n // 4:
        return ("predict", mode)
    levels = image[..., 2].astype(np.int16)
    for first, c in ((True, 1), (False, 3)):  # red, then blue, of green
        for f in FACTORS:
            left = (image[..., c] - (f * np.where(levels > 127, levels - 256, levels) >> 5)) & 255
            if np.count_nonzero(left) < n // 8 and np.count_nonzero(image[..., c]) > n // 2:
                return ("cross", f if first else 0, 0 if first else f)
    return None


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8).astype(np.int8).astype(np.int64)


def _transformed(image: np.ndarray, transform: tuple | None, out: Writer) -> np.ndarray:
    """Write the transform and give the image that is left."""
    h, w, _ = image.shape
    if transform is None:
        return image
    out.put(1, 1)
    if transform[0] == "palette":
        return _to_palette(image, out)
    blocks = ((w + 511) >> 9) * ((h + 511) >> 9)
    out.put(0 if transform[0] == "predict" else 1, 2)
    out.put(7, 3)  # blocks of 512
    if transform[0] == "predict":
        write_image(out, [0xFF000000 | transform[1] << 8] * blocks, (w + 511) >> 9, False)
        return residuals_of(image, transform[1])
    red, blue = transform[1:]
    write_image(out, [0xFF000000 | (blue & 255) << 8 | red & 255] * blocks, (w + 511) >> 9, False)
    return cross_colour(image, np.broadcast_to(np.array([red, blue, 0], np.int8), ((h + 511) >> 9, (w + 511) >> 9, 3)), 9, False)


def copies_of(pixels: np.ndarray, own: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
    """Back-references (place, length, distance) in the pixels of several images: at each place that no other covers,
    the latest earlier place in the image of the same LEAST_COPY pixels, copied as far as it agrees."""
    n = len(pixels) - LEAST_COPY + 1
    if n <= 0:
        return []
    key = pixels[:n].astype(np.uint64)
    for i in range(1, LEAST_COPY):
        key = mix(key) ^ pixels[i : i + n]
    key = mix(key) ^ own[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    # The place in the low bits makes keys unlike, so that a plain sort keeps equal ones in order of place.
    low = np.uint64((1 << n.bit_length()) - 1)
    key = np.sort((mix(key) & ~low) | np.arange(n, dtype=np.uint64))
    again = np.flatnonzero((key[1:] ^ key[:-1]) <= low)
    place, source = (key[again + 1] & low).astype(np.int64), (key[again] & low).astype(np.int64)
    inside = (own[place] == own[source]) & (place + LEAST_COPY <= first[own[place] + 1])
    for i in range(LEAST_COPY):
        inside &= pixels[place + i] == pixels[source + i]
    place, source = place[inside], source[inside]
    ranked = np.argsort(place)
    out, end = [], 0
    stop = first[own[place[ranked]] + 1].tolist() if len(place) else []
    for p, s, e in zip(place[ranked].tolist(), source[ranked].tolist(), stop):
        if p < end:
            continue
        most, length = min(MOST_COPY, e - p), LEAST_COPY
        while length < most:
            step = min(max(16, length), most - length)
            differ = pixels[p + length : p + length + step] != pixels[s + length : s + length + step]
            if differ.any():
                length += int(differ.argmax())
                break
            length += step
        out.append((p, length, p - s))
        end = p + length
    return out


def pack_many(images: list[np.ndarray]) -> list[bytes]:
    """A lossless file of each image (height, width, 4) of A, R, G, B."""
    if not images:
        return []
    heads, left = [], []
    for image in images:
        out = Writer()
        out.put(0x2F, 8)
        out.put(image.shape[1] - 1, 14)
        out.put(image.shape[0] - 1, 14)
        out.put(int((image[..., 0] != 255).any()), 1)
        out.put(0, 3)
        left.append(_transformed(image, chosen_transform(image), out))
        out.put(0, 1)
        heads.append((int.from_bytes(out.done(), "little"), sum(map(len, out.parts)) * 8 + out.n))
    sizes = np.array([x.shape[0] * x.shape[1] for x in left])
    first = np.concatenate([[0], np.cumsum(sizes)])
    samples = np.concatenate([x.reshape(-1, 4) for x in left])
    pixels = np.ascontiguousarray(samples).view(">u4").ravel().astype(np.uint32)
    own = np.repeat(np.arange(len(left)), sizes)
    # Symbols: literals have four fields, copies two, cached pixels one, and what copies cover none.
    copies = copies_of(pixels, own, first)
    covered, starts = np.zeros(len(pixels) + 1, np.int64), np.array([c[0] for c in copies], np.int64)
    lengths, distances = (np.array([c[i] for c in copies], np.int64) for i in (1, 2))
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + lengths, -1)
    literal = np.cumsum(covered[:-1]) == 0
    slot = (pixels * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - CACHE_BITS)
    bits = np.uint64(len(pixels).bit_length())
    order = np.sort((own.astype(np.uint64) << np.uint64(CACHE_BITS) | slot) << bits | np.arange(len(pixels), dtype=np.uint64))
    order = (order & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    hit = np.zeros(len(pixels), bool)
    hit[order[1:]] = (pixels[order[1:]] == pixels[order[:-1]]) & (own[order[1:]] == own[order[:-1]])
    hit &= literal
    # The cheapest coding of each image, by the bits of its literals and cached pixels.
    every, per = codings(), np.zeros((len(codings()), len(left)))
    fields = samples[:, (2, 1, 3, 0)]  # green, red, blue, alpha
    whole = literal & ~hit
    cached = np.bincount(own[hit], minlength=len(left))
    for k, coding in enumerate(every):
        if k % 2 == 0:
            cost = sum(coding.sizes[c].astype(np.uint8)[fields[:, c]] for c in range(4))
            alone, again = (np.bincount(own[some], cost[some], len(left)) for some in (whole, hit))
        per[k] = alone + coding.head[1] + (cached * int(coding.sizes[0][-1]) if coding.cache else again)
    best = per.argmin(0)
    kind = best.astype(np.int64)[own]
    hit &= kind % 2 == 1
    whole = literal & ~hit
    value, count = np.zeros((len(pixels), 4), np.uint64), np.zeros((len(pixels), 4), np.int64)
    for c in range(4):
        at = kind[whole] * 256 + fields[whole, c]
        value[whole, c] = np.concatenate([x.bits[c][:256] for x in every])[at]
        count[whole, c] = np.concatenate([x.sizes[c][:256] for x in every])[at]
    for k in np.unique(best[np.unique(own[hit])]).tolist():
        some = hit & (kind == k)
        value[some, 0], count[some, 0] = every[k].bits[0][280 + slot[some]], every[k].sizes[0][280 + slot[some]]
    near = {144 * y + x: i for i, (x, y) in reversed([*enumerate(NEAR, 1)])}
    files = []
    copy_at = np.searchsorted(starts, first)
    for i in range(len(left)):
        coding, lo, hi = every[best[i]], first[i], first[i + 1]
        width = left[i].shape[1]
        for j in range(copy_at[i], copy_at[i + 1]):
            d = int(distances[j])
            d = near.get(d, d + 120) if width == 144 else d + 120
            for c, code, offset, x in ((0, 0, 256, int(lengths[j])), (1, 4, 0, d)):
                symbol, extra, more = _prefixed(x)
                size = int(coding.sizes[code][offset + symbol])
                value[starts[j], c], count[starts[j], c] = int(coding.bits[code][offset + symbol]) | extra << size, size + more
        files.append(contained(_stream(heads[i], coding.head, value[lo:hi].ravel(), count[lo:hi].ravel())))
    return files


def _stream(one: tuple[int, int], two: tuple[int, int], value: np.ndarray, n: np.ndarray) -> bytes:
    """The bits of two heads and of many fields."""
    start = one[1] + two[1]
    lead = (one[0] | two[0] << one[1]).to_bytes(-(-start // 32) * 4, "little")
    at = np.cumsum(n)
    total = start + int(at[-1])
    at += start - n
    words = np.zeros(-(-total // 32) + 2, np.float64)
    value = value << (at & 31).astype(np.uint64)
    place = at >> 5
    words[: len(lead) // 4] += np.frombuffer(lead, "<u4")
    words += np.bincount(place, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), len(words))
    words += np.bincount(place + 1, (value >> np.uint64(32)).astype(np.float64), len(words))
    return words.astype(np.uint64).astype("<u4").tobytes()[: -(-total // 8)]


class _Tables:
    """Decoding tables of the prefix codes that a set of files has, one after another: symbol and length by bits."""

    def __init__(self):
        self.parts, self.size, self.known = [], 0, {}

    def add(self, code: Code) -> tuple[int, int]:
        """Where the code's table begins, and the mask of its bits."""
        raw = (code.lengths.astype(np.int64) << 16) | code.symbols
        key = raw.tobytes()
        if key not in self.known:
            self.known[key] = self.size, (1 << code.width) - 1
            self.parts.append(raw)
            self.size += len(raw)
        return self.known[key]


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """The pixels (height, width, 4) of A, R, G, B of each file: as `decode` gives them, many at a time."""
    out: list = [None] * len(files)
    tables, heads = _Tables(), {}
    jobs = []  # file, stream, bits read, width, height, transforms, cache bits, tables
    for i, file in enumerate(files):
        stream = stream_of(file)
        bits = Bits(stream)
        width, h = head(bits)
        todo, w = transforms_of(bits, width, h)
        # Heads of codes that are met again aren't read again.
        raw = int.from_bytes(stream[bits.at >> 3 : (bits.at >> 3) + 512], "little") >> (bits.at & 7)
        found = next((x for x in heads.items() if raw & ((1 << x[0][0]) - 1) == x[0][1]), None)
        if found is None:
            at = bits.at
            cache = bits.read(4) if bits.read(1) else 0
            if cache > 11:
                raise ValueError("a colour cache of over 11 bits")
            if bits.read(1):
                out[i] = decode(file)  # meta prefix codes
                continue
            codes = [tables.add(read_code(bits, n + (c == 0 and (1 << cache if cache else 0)))) for c, n in enumerate(CODES)]
            size = bits.at - at
            if size <= 3800 and len(heads) < 64:
                heads[(size, raw & ((1 << size) - 1))] = (cache, codes)
        else:
            (size, _), (cache, codes) = found
            bits.at += size
        jobs.append((i, stream, bits.at, w, h, todo, cache, codes))
    if jobs:
        for job, pixels in zip(jobs, _pixels(jobs, np.concatenate(tables.parts))):
            i, _, _, w, h, todo, _, _ = job
            out[i] = restored(np.ascontiguousarray(pixels.astype(">u4")).view(np.uint8).reshape(h, w, 4), todo)
    return out


def _pixels(jobs: list[tuple], table: np.ndarray) -> list[np.ndarray]:
    """The entropy-coded pixels of each job, one symbol of each at a step."""
    n = len(jobs)
    total = np.array([j[3] * j[4] for j in jobs])
    to = np.concatenate([[0], np.cumsum(total)])
    out = np.zeros(int(to[-1]), np.uint32)
    base = np.cumsum([0, *(len(j[1]) for j in jobs)])
    raw = b"".join([*(j[1] for j in jobs), b"\0" * 16])
    window = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))  # the 8 bytes from each byte on
    place = base[:-1] * 8 + np.array([j[2] for j in jobs])
    end = base[1:] * 8
    start = [np.array([j[7][c][0] for j in jobs]) for c in range(5)]
    mask = [np.array([j[7][c][1] for j in jobs], np.uint64) for c in range(5)]
    cache_bits = np.array([j[6] for j in jobs])
    slots = np.where(cache_bits > 0, 1 << cache_bits, 1)
    cache_at, cache = np.cumsum(slots) - slots, np.zeros(int(slots.sum()), np.uint32)
    shift = np.where(cache_bits > 0, 32 - cache_bits, 31).astype(np.uint32)
    keeps = bool((cache_bits > 0).any())
    at = to[:-1].copy()

    def peek(i):
        p = place[i]
        return window[p >> 3] >> (p & 7).astype(np.uint64)

    def look(w, i, c):
        """Symbol and length of the code that the bits w begin with."""
        return table[start[c][i] + (w & mask[c][i]).astype(np.int64)]

    def read(i, c):
        got = look(peek(i), i, c)
        place[i] += got >> 16
        return got & 0xFFFF

    # A window has 57 bits from any place on: enough for the four codes of a pixel, unless they are all very long.
    once = sum(int(m.max()).bit_length() for m in mask[:4]) <= 57

    def number(i, symbol):
        """A length or distance from its prefix symbol and extra bits."""
        more = np.maximum(symbol - 2 >> 1, 0)
        extra = (peek(i) & ((np.uint64(1) << more.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
        place[i] += more
        return np.where(symbol < 4, symbol + 1, ((2 + (symbol & 1)) << more) + extra + 1)

    active = np.arange(n)
    steps = 0
    while len(active):
        w = peek(active)
        got = look(w, active, 0)
        s, used = got & 0xFFFF, got >> 16
        plain = s < 256
        if plain.all():
            some, g = active, s
        else:
            place[active[~plain]] += used[~plain]
            some, g, w, used = active[plain], s[plain], w[plain], used[plain]
        if len(some):
            p = g << 8
            for c, to_bit in ((1, 16), (2, 0), (3, 24)):
                if once:
                    rest = w >> used.astype(np.uint64)
                else:
                    q = place[some] + used
                    rest = window[q >> 3] >> (q & 7).astype(np.uint64)
                got = look(rest, some, c)
                p |= (got & 0xFFFF) << to_bit
                used = used + (got >> 16)
            place[some] += used
            p = p.astype(np.uint32)
            out[at[some]] = p
            at[some] += 1
            if keeps:
                cache[cache_at[some] + np.where(cache_bits[some] > 0, (p * np.uint32(CACHE_FACTOR)) >> shift[some], 0)] = p
        if len(some) < len(active):
            cached = s >= 280
            if cached.any():
                f = active[cached]
                out[at[f]] = cache[cache_at[f] + s[cached] - 280]
                at[f] += 1
            copied = ~plain & ~cached
            if copied.any():
                f = active[copied]
                length = number(f, s[copied] - 256)
                for i, m, d in zip(f.tolist(), length.tolist(), number(f, read(f, 4)).tolist()):
                    if d > 120:
                        d -= 120
                    else:
                        dx, dy = NEAR[d - 1]
                        d = max(1, dx + dy * jobs[i][3])
                    a = int(at[i])
                    if a - d < to[i] or a + m > to[i + 1]:
                        raise ValueError("a back-reference outside the image")
                    out[a : a + m] = out[a - d : a - d + m] if d >= m else np.resize(out[a - d : a], m)
                    at[i] += m
                    if cache_bits[i]:
                        new = out[a : a + m]
                        cache[cache_at[i] + ((new * np.uint32(CACHE_FACTOR)) >> shift[i])] = new
        steps += 1
        done = at[active] == to[active + 1]
        if done.any():
            active = active[~done]
        if steps % 1024 == 0 and (place[active] > end[active]).any():
            break
    if (place > end).any():
        raise ValueError("the stream ends early")
    return [out[a:b] for a, b in zip(to[:-1], to[1:])]


#: Bytes of text that are packed and read together.
GROUP_BYTES = 8 << 20


def media(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), stored: bool = False, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Store each text's payload as lossless images, read them back and describe them.

    `keep`, n_bytes, payload_bytes, payload_sha256 and tail_crc32 (of the payload as read back), media_bytes,
    media_sha256, feature (shapes, sample means and a histogram of 16 classes, from the pixels), and with `stored` the
    files themselves, one after another, as `media`.
    """
    prepare(df.sparkSession)
    df = df.select(*keep, df[text].cast("string").alias("_text"))
    names = [*keep, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *(["media"] if stored else [])]

    def run(batches):
        for batch in gathered(batches, len(keep), group_bytes):
            data, off = flat(batch.column(len(keep)))
            sizes = np.diff(off).tolist()
            images, count = [], []
            for a, n in zip(off.tolist(), sizes):
                own = images_of(np.concatenate([data[a : a + n], np.full(-n % ROW if n else ROW, 255, np.uint8)]))
                images += own
                count.append(len(own))
            files = pack_many(images)
            shapes, images = [f"{x.shape[1]}x{x.shape[0]}" for x in images], None
            read, rows, at = decode_many(files), [[] for _ in range(8)], 0
            for n, c in zip(sizes, count):
                samples = np.concatenate([x[..., (2, 1, 3, 0)].ravel() for x in read[at : at + c]])
                payload = samples[: max(ROW, -(-n // ROW) * ROW)]
                raw, file = payload.tobytes(), b"".join(files[at : at + c])
                grams = np.bincount(payload >> 4, minlength=16)
                feature = "+".join(shapes[at : at + c]) + ";" + ",".join(f"{x:.4f}" for x in payload.reshape(-1, 4).mean(0)) + ";" + ",".join(map(str, grams.tolist()))
                for column, x in zip(rows, (n, len(raw), sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(file), sha256(file).hexdigest(), feature, file)):
                    column.append(x)
                at += c
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *(pa.array(c, t) for c, t in list(zip(rows, kinds))[: 7 + stored])], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "_text")
    return df.mapInArrow(run, f"{kinds}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * stored)


def read_media(df: DataFrame, column: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, width, height and samples (A, R, G, B bytes) of any lossless WebP files; null for what can't be read."""
    prepare(df.sparkSession)
    df = df.select(*keep, df[column].cast("binary").alias("_file"))

    def one(file):
        try:
            image = decode(file)
            return image.shape[1], image.shape[0], image.tobytes()
        except (ValueError, IndexError, TypeError):
            return None, None, None

    def run(batches):
        for batch in batches:
            got = [one(x) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.binary())], [*keep, "width", "height", "samples"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "_file")
    return df.mapInArrow(run, f"{kinds}, width int, height int, samples binary")
