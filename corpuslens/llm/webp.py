"""Lossless WebP (VP8L) as a media column: an encoder and a decoder to pixel arrays.

The decoder reads the RIFF container and the whole lossless bitstream: prefix codes (simple and normal, their lengths
coded by codes), entropy images with several code groups, back-references with the distance map, the colour cache, and
the four transforms (predictor, cross-colour, subtract green, palette with bundled pixels) inverted in reverse order.
Streams under one code group without a colour cache take a vectorised path: every bit position is decoded at once by
table, and only the positions where pixels or back-references start are followed one by one. All others are decoded
pixel by pixel.

The encoder of grey images picks the smallest of literals, literals with back-references, and a palette with bundled
pixels. A general one adds each transform, a colour cache and back-references on request; the tests use it to exercise the
whole decoder.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_MULTIPLIER = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
SIDE = 1 << 14


def _near() -> list[tuple[int, int]]:
    """The 120 short distances (dx, dy), nearest first: those ahead of the pixel in scan order, within 8 columns and 8 rows."""
    cells = [(x, y) for y in range(8) for x in range(-7, 9) if y > 0 or x > 0]
    # By distance; of equally far ones the steeper first, and to the left's mirror image (positive x) before it.
    return sorted(cells, key=lambda c: (c[0] ** 2 + c[1] ** 2, abs(c[0]), c[0] < 0))


class BitReader:
    """Bits of a byte string, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        a = self.at >> 3
        v = int.from_bytes(self.data[a : a + 5], "little") >> (self.at & 7)
        self.at += n
        if self.at > 8 * len(self.data) + 64:
            raise ValueError("the stream ends early")
        return v & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        a = self.at >> 3
        return (int.from_bytes(self.data[a : a + 5], "little") >> (self.at & 7)) & ((1 << n) - 1)


class BitWriter:
    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def write(self, v: int, n: int) -> None:
        self.value |= v << self.n
        self.n += n


#: The 15 bits of each number in reverse; no code is longer.
REVERSED = sum(((np.arange(1 << 15) >> k) & 1) << (14 - k) for k in range(15))


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The codes of canonical prefix codes, bits reversed for a stream that starts with the least significant."""
    codes = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    if not len(used):
        return codes
    order = used[np.lexsort((used, lengths[used]))]
    sizes = lengths[order].astype(np.int64)
    # A code is the sum of what the codes before it take up of the unit interval.
    top = int(sizes.max())
    taken = np.cumsum(1 << (top - sizes)) - (1 << (top - sizes))
    codes[order] = taken >> (top - sizes)
    # Reverse each within its own length.
    codes[order] = REVERSED[taken >> (top - sizes)] >> (15 - sizes)
    return codes


class Code:
    """A prefix code as a table over its longest length: symbol and length of every bit pattern."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) == 0:
            raise ValueError("a prefix code has no symbol")
        if len(used) == 1:  # one symbol takes no bits
            self.bits, self.symbol, self.length = 0, np.array([used[0]]), np.array([0])
        else:
            self.bits = top = int(lengths.max())
            sizes = lengths[used].astype(np.int64)
            if int((1 << (top - sizes)).sum()) != 1 << top:
                raise ValueError("a prefix code is not complete")
            # In the order of their codes the symbols take up the table one after another, its places read with their first bit highest.
            order = np.lexsort((used, sizes))
            symbol, length = used[order], sizes[order]
            at = np.repeat(np.arange(len(order)), 1 << (top - length))[REVERSED[: 1 << top] >> (15 - top)]
            self.symbol, self.length = symbol[at], length[at]
        self.single = self.bits == 0
        self.lists: tuple[list, list] | None = None

    def next(self, r: BitReader) -> int:
        if self.lists is None:
            self.lists = self.symbol.tolist(), self.length.tolist()
        v = r.peek(self.bits)
        r.at += self.lists[1][v]
        return self.lists[0][v]


_CODES: dict[bytes, Code] = {}


def code_of(lengths: np.ndarray) -> Code:
    """The code of these lengths; a few are remembered, as a file's codes are often alike."""
    used = np.flatnonzero(lengths)
    key = lengths[: used[-1] + 1].astype(np.uint8).tobytes() if len(used) else b""
    found = _CODES.get(key)
    if found is None:
        if len(_CODES) >= 16:
            _CODES.clear()
        found = _CODES[key] = Code(lengths)
    return found


def read_code(r: BitReader, alphabet: int) -> Code:
    lengths = np.zeros(alphabet, np.int64)
    if r.read(1):
        two, wide = r.read(1), r.read(1)
        first = r.read(8 if wide else 1)
        lengths[first] = 1
        if two:
            lengths[r.read(8)] = 1
        return code_of(lengths)
    steps = np.zeros(19, np.int64)
    for i in range(4 + r.read(4)):
        steps[CODE_LENGTH_ORDER[i]] = r.read(3)
    code = code_of(steps)
    left = 2 + r.read(2 + 2 * r.read(3)) if r.read(1) else alphabet
    at, before, out = 0, 8, lengths
    while at < alphabet and left > 0:
        left -= 1
        s = code.next(r)
        if s < 16:
            out[at] = s
            at += 1
            before = s or before
        else:
            value, n = (before, 3 + r.read(2)) if s == 16 else (0, 3 + r.read(3)) if s == 17 else (0, 11 + r.read(7))
            if at + n > alphabet:
                raise ValueError("code lengths run over")
            out[at : at + n] = value
            at += n
    return code_of(lengths)


def prefix_value(symbol: int, r: BitReader) -> int:
    """A length or distance: the symbol gives its range, further bits the place in it."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + r.read(extra) + 1


def prefix_of(value: int) -> tuple[int, int, int]:
    """The inverse: symbol, number of further bits, their value."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    extra = v.bit_length() - 2
    return 2 * extra + 2 + (v >> extra & 1), extra, v & ((1 << extra) - 1)


def read_image(r: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as ARGB words, row after row."""
    cache_bits = r.read(4) if r.read(1) else 0
    groups, block, index = 1, 0, None
    if main and r.read(1):
        block = r.read(3) + 2
        across = (width + (1 << block) - 1) >> block
        meta = read_image(r, across, (height + (1 << block) - 1) >> block, False)
        index = (meta >> 8) & 0xFFFF
        groups = int(index.max()) + 1
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[read_code(r, n) for n in sizes] for _ in range(groups)]
    if groups == 1 and not cache_bits:
        out = _events(r, codes[0], width, width * height)
        if out is not None:
            return out
    return _general(r, codes, width, height, cache_bits, block, index)


def _prefix_values(symbol: np.ndarray, at: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """prefix_value() for many symbols whose further bits start at the bit positions `at`: values, and where they end."""
    extra = np.where(symbol < 4, 0, (symbol - 2) >> 1)
    bits = (word[np.minimum(at >> 3, len(word) - 1)].astype(np.int64) >> (at & 7)) & ((1 << extra) - 1)
    return np.where(symbol < 4, symbol, ((2 + (symbol & 1)) << extra) + bits) + 1, at + extra


def _follow(step: np.ndarray, p: int, limit: int) -> np.ndarray:
    """The positions below `limit` that are reached from p on, where `step` has the next of each. Four steps are taken at once, as only these are
    followed one by one."""
    two = step.take(step)
    four = two.take(two)
    hop, at = memoryview(four), []
    while p < limit:
        at.append(p)
        p = hop[p]
    one = np.array(at, np.int64)
    out = np.empty((len(one), 4), np.int64)
    out[:, 0], out[:, 1], out[:, 2] = one, step[one], two[one]
    out[:, 3] = step[out[:, 2]]
    out = out.ravel()
    return out[: int(np.searchsorted(out, limit))]


def _events(r: BitReader, codes: list[Code], width: int, n: int) -> np.ndarray | None:
    """All pixels of one code group without a colour cache: for each bit position the pixel or back-reference that would start there,
    and where the next would; from the first on, only those that do are followed. Back-references are then copied in order."""
    green, red, blue, alpha, distance = codes
    if all(c.single for c in codes[:4]) and green.symbol[0] < 256:
        value = int(alpha.symbol[0]) << 24 | int(red.symbol[0]) << 16 | int(green.symbol[0]) << 8 | int(blue.symbol[0])
        return np.full(n, value, np.uint32)
    if green.single and green.symbol[0] > 255:
        return None
    refers = int(green.symbol.max()) > 255
    longest = sum(c.bits for c in (green, red, blue, alpha))
    first = r.at >> 3
    most = len(r.data) if refers else min(len(r.data), first + (n * longest >> 3) + 8) + 8
    data = np.frombuffer(r.data[first:most] + bytes(16), np.uint8)
    words = np.ndarray((len(data) - 3,), "<u4", data.data, strides=(1,))
    # The 15 bits from every position on fit in 32 bits from its byte on.
    window = ((words[:, None] >> np.arange(8, dtype=np.uint32)[None, :]) & np.uint32(0x7FFF)).ravel()
    end = len(window) - 1
    step = np.arange(len(window), dtype=np.int32)
    for k, c in enumerate((green, red, blue, alpha)):
        if not c.single:
            w = window[step] if k else window
            step += c.length.astype(np.int32).take(w & np.uint32((1 << c.bits) - 1), mode="clip")
            np.minimum(step, end, out=step)
    limit, copies = min(8 * (len(r.data) - first), end), None
    if refers:
        kind = green.symbol.astype(np.int32).take(window & np.uint32((1 << green.bits) - 1), mode="clip")
        where = np.flatnonzero(kind > 255)
        lengths, q = _prefix_values(kind[where] - 256, where + green.length[window[where] & np.uint32((1 << green.bits) - 1)], words)
        v = window[np.minimum(q, end)] & np.uint32((1 << distance.bits) - 1)
        back, q = _prefix_values(distance.symbol[v], np.minimum(q + distance.length[v], end), words)
        step[where] = np.minimum(q, end)
        made = np.ones(len(window), np.int32)
        made[where] = lengths
        at = _follow(step, r.at & 7, limit)
        upto = np.cumsum(made[at], dtype=np.int64)
        k = int(np.searchsorted(upto, n))
        if k == len(at):
            raise ValueError("the stream ends early")
        if upto[k] > n:
            raise ValueError("a back-reference runs over the image")
        at = at[: k + 1]
        p = int(step[at[-1]])
        place = upto[: k + 1] - made[at]
        is_copy = kind[at] > 255
        found = np.searchsorted(where, at[is_copy])
        copies = list(zip(place[is_copy].tolist(), lengths[found].tolist(), back[found].tolist(), strict=True))
        at, place = at[~is_copy], place[~is_copy]
    else:
        at = _follow(step, r.at & 7, limit)[:n]
        if len(at) < n:
            raise ValueError("the stream ends early")
        p = int(step[at[-1]])
    value = np.zeros(len(at), np.uint32)
    for c, shift in ((green, 8), (red, 16), (blue, 0), (alpha, 24)):
        if c.single:
            value |= np.uint32(int(c.symbol[0]) << shift)
            continue
        w = window[at] & np.uint32((1 << c.bits) - 1)
        value |= c.symbol[w].astype(np.uint32) << np.uint32(shift)
        at = at + c.length[w]
    if p > 8 * (len(r.data) - first):
        raise ValueError("the stream ends early")
    r.at = first * 8 + p
    if copies is None:
        return value
    out, near = np.zeros(n, np.uint32), near_distances()
    out[place] = value
    for to, length, d in copies:
        d = d - 120 if d > 120 else max(1, near[d - 1][0] + near[d - 1][1] * width)
        if d > to:
            raise ValueError("a back-reference starts before the image")
        out[to : to + length] = out[to - d : to - d + length] if d >= length else np.resize(out[to - d : to], length)
    return out


def _general(r: BitReader, codes: list[list[Code]], width: int, height: int, cache_bits: int, block: int, index: np.ndarray | None) -> np.ndarray:
    n = width * height
    out, cache = [0] * n, [0] * (1 << cache_bits if cache_bits else 0)
    shift, near = 32 - cache_bits, near_distances()
    across = (width + (1 << block) - 1) >> block
    which = index.tolist() if index is not None else None
    group, i, cached = codes[0], 0, 0
    while i < n:
        if which is not None:
            group = codes[which[(i // width >> block) * across + (i % width >> block)]]
        s = group[0].next(r)
        if s < 256:
            red = group[1].next(r)
            blue = group[2].next(r)
            out[i] = group[3].next(r) << 24 | red << 16 | s << 8 | blue
            i += 1
        elif s < 280:
            length = prefix_value(s - 256, r)
            d = prefix_value(group[4].next(r), r)
            d = d - 120 if d > 120 else max(1, near[d - 1][0] + near[d - 1][1] * width)
            if d > i or i + length > n:
                raise ValueError("a back-reference leaves the image")
            for k in range(length):
                out[i + k] = out[i + k - d]
            i += length
        else:
            while cached < i:
                cache[(CACHE_MULTIPLIER * out[cached] & 0xFFFFFFFF) >> shift] = out[cached]
                cached += 1
            out[i] = cache[s - 280]
            i += 1
    return np.array(out, np.uint32)


_NEAR: list[tuple[int, int]] = []


def near_distances() -> list[tuple[int, int]]:
    if not _NEAR:
        _NEAR.extend(_near())
    return _NEAR


def _channels(argb: np.ndarray) -> np.ndarray:
    """[..., 4] as alpha, red, green, blue."""
    return np.stack([(argb >> np.uint32(s)) & np.uint32(255) for s in (24, 16, 8, 0)], -1).astype(np.int64)


def _words(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def predict(mode: int, left: list, top: list, top_left: list, top_right: list) -> list:
    """A pixel foretold from its neighbours ([A, R, G, B] each), by the format's fourteen modes."""
    mean = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    clamp = lambda v: 0 if v < 0 else 255 if v > 255 else v
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return mean(mean(left, top_right), top)
    if mode == 6:
        return mean(left, top_left)
    if mode == 7:
        return mean(left, top)
    if mode == 8:
        return mean(top_left, top)
    if mode == 9:
        return mean(top, top_right)
    if mode == 10:
        return mean(mean(left, top_left), mean(top, top_right))
    if mode == 11:
        # Nearer of left and top to left + top - top-left, over all channels.
        to_left = sum(abs(t - c) for t, c in zip(top, top_left, strict=True))
        to_top = sum(abs(a - c) for a, c in zip(left, top_left, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [clamp(a + t - c) for a, t, c in zip(left, top, top_left, strict=True)]
    if mode == 13:
        m = mean(left, top)
        return [clamp(a + int((a - c) / 2)) for a, c in zip(m, top_left, strict=True)]
    return [255, 0, 0, 0]


def run_predictor(c: np.ndarray, modes: np.ndarray, bits: int, forward: bool) -> np.ndarray:
    """Adds (or with `forward` subtracts) predictions over [H, W, 4]."""
    h, w, _ = c.shape
    source = c.tolist()
    out = [[None] * w for _ in range(h)]
    full = source if forward else out
    for y in range(h):
        for x in range(w):
            if y == 0 and x == 0:
                p = [255, 0, 0, 0]
            elif y == 0:
                p = full[0][x - 1]
            elif x == 0:
                p = full[y - 1][0]
            else:
                above = full[y - 1]
                # Right of the last column stands the row's own first pixel.
                right = above[x + 1] if x + 1 < w else full[y][0]
                p = predict(int(modes[y >> bits, x >> bits]), full[y][x - 1], above[x], above[x - 1], right)
            out[y][x] = [(v - q if forward else v + q) & 255 for v, q in zip(source[y][x], p, strict=True)]
    return np.array(out, np.int64).reshape(h, w, 4)


def run_cross_colour(c: np.ndarray, elements: np.ndarray, bits: int, forward: bool) -> np.ndarray:
    """Red and blue by multiples of green (and blue by red): elements [.., 4] hold red-to-blue, green-to-blue, green-to-red in R, G, B."""
    h, w, _ = c.shape
    e = elements[np.arange(h) >> bits][:, np.arange(w) >> bits]
    signed = lambda v: (v.astype(np.int64) + 128) % 256 - 128
    delta = lambda t, v: (signed(t) * signed(v)) >> 5
    out = c.copy()
    red, green, blue = c[..., 1], c[..., 2], c[..., 3]
    if forward:
        out[..., 1] = (red - delta(e[..., 3], green)) & 255
        out[..., 3] = (blue - delta(e[..., 2], green) - delta(e[..., 1], red)) & 255
    else:
        new = (red + delta(e[..., 3], green)) & 255
        out[..., 1] = new
        out[..., 3] = (blue + delta(e[..., 2], green) + delta(e[..., 1], new)) & 255
    return out


def bundle(colours: int) -> int:
    """log2 of how many pixels of a palette share one."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def decode(data: bytes) -> np.ndarray:
    """[height, width, 4] pixels (alpha, red, green, blue) of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(data) and data[at : at + 4] != b"VP8L":
        at += 8 + (struct.unpack_from("<I", data, at + 4)[0] + 1 & ~1)
    if data[at : at + 4] != b"VP8L":
        raise ValueError("no lossless image in the file")
    size = struct.unpack_from("<I", data, at + 4)[0]
    r = BitReader(data[at + 8 : at + 8 + size])
    if r.read(8) != 0x2F:
        raise ValueError("the image's signature is wrong")
    width, height = r.read(14) + 1, r.read(14) + 1
    r.read(1)
    if r.read(3):
        raise ValueError("unknown version")
    transforms, inner = [], width
    while r.read(1):
        kind = r.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.read(3) + 2
            w, h = (inner + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits
            transforms.append((kind, bits, inner, read_image(r, w, h, False).reshape(h, w)))
        elif kind == PALETTE:
            n = r.read(8) + 1
            deltas = _channels(read_image(r, n, 1, False))
            transforms.append((kind, bundle(n), inner, _words(np.cumsum(deltas, 0) & 255)))
            inner = (inner + (1 << bundle(n)) - 1) >> bundle(n)
        else:
            transforms.append((kind, 0, inner, None))
    argb = read_image(r, inner, height, True).reshape(height, inner)
    for kind, bits, w, extra in reversed(transforms):
        if kind == PALETTE:
            index = (argb >> np.uint32(8)) & np.uint32(255)
            if bits:
                each = 8 >> bits
                index = (index[:, :, None] >> (np.arange(1 << bits, dtype=np.uint32) * np.uint32(each))) & np.uint32((1 << each) - 1)
                index = index.reshape(height, -1)[:, :w]
            colours = np.zeros(256, np.uint32)
            colours[: len(extra)] = extra
            argb = colours[index]
            continue
        if kind == SUBTRACT_GREEN:  # added to red and blue in one, 16 bits apart
            green = (argb >> np.uint32(8)) & np.uint32(255)
            both = (argb & np.uint32(0xFF00FF)) + (green << np.uint32(16) | green)
            argb = (argb & np.uint32(0xFF00FF00)) | (both & np.uint32(0xFF00FF))
            continue
        c = _channels(argb)
        if kind == PREDICTOR:
            c = run_predictor(c, (extra >> np.uint32(8)) & np.uint32(15), bits, False)
        else:
            c = run_cross_colour(c, _channels(extra), bits, False)
        argb = _words(c)
    return np.ascontiguousarray(argb).astype("<u4").view(np.uint8).reshape(height, width, 4)[..., ::-1]


def huffman_lengths(counts: np.ndarray, longest: int = 12) -> np.ndarray:
    """Code lengths of at most `longest` bits for the symbols that occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    heap = [(int(counts[s]), i) for i, s in enumerate(used)]
    heapq.heapify(heap)
    parent, n = [0] * (2 * len(used)), len(used)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        parent[a[1]] = parent[b[1]] = n
        heapq.heappush(heap, (a[0] + b[0], n))
        n += 1
    depth = [0] * n
    for i in range(n - 2, -1, -1):
        depth[i] = depth[parent[i]] + 1
    d = np.array(depth[: len(used)], np.int64)
    if d.max() > longest:  # shorten the long ones, then pay by lengthening the longest of the others
        d = np.minimum(d, longest)
        over = int((1 << (longest - d)).sum()) - (1 << longest)
        for i in sorted(range(len(d)), key=lambda i: int(counts[used[i]])):
            while over > 0 and d[i] < longest:
                d[i] += 1
                over -= 1 << (longest - d[i])
        for i in sorted(range(len(d)), key=lambda i: -int(counts[used[i]])):
            while over < 0 and d[i] > 1 and over + (1 << (longest - d[i])) <= 0:
                over += 1 << (longest - d[i])
                d[i] -= 1
    lengths[used] = d
    return lengths


def write_code(w: BitWriter, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (len(used) == 0 or used.max() < 256):
        a = int(used[0]) if len(used) else 0
        w.write(1, 1)
        w.write(int(len(used) == 2), 1)
        w.write(1, 1)
        w.write(a, 8)
        if len(used) == 2:
            w.write(int(used[1]), 8)
        return
    w.write(0, 1)
    # Lengths 0 to 13 and the long run of zeros (18) and the short one (17): sixteen codes of four bits.
    w.write(15, 4)
    for s in CODE_LENGTH_ORDER:
        w.write(4 if s <= 13 or s in (17, 18) else 0, 3)
    name = {s: i for i, s in enumerate([*range(14), 17, 18])}
    flip = [int(f"{i:04b}"[::-1], 2) for i in range(16)]
    tokens: list[tuple[int, int, int]] = []
    at = 0
    for u in [*used.tolist(), None]:
        gap = (u if u is not None else at) - at
        while gap:
            n = min(gap, 138)
            if n >= 11:
                tokens.append((18, n - 11, 7))
            elif n >= 3:
                tokens.append((17, n - 3, 3))
            else:
                tokens += [(0, 0, 0)] * n
            gap -= n
        if u is not None:
            tokens.append((int(lengths[u]), 0, 0))
            at = u + 1
    if len(tokens) >= 2:
        w.write(1, 1)
        count = len(tokens) - 2
        size = max(1, (count.bit_length() + 1) // 2)
        w.write(size - 1, 3)
        w.write(count, 2 * size)
    else:
        w.write(0, 1)
    for s, extra, n in tokens:
        w.write(flip[name[s]] | extra << 4, 4 + n)


def _pack(w: BitWriter, values: np.ndarray, sizes: np.ndarray) -> None:
    """Append values of the given numbers of bits (up to 56 each) in order."""
    ends = np.cumsum(sizes) + w.n
    starts = ends - sizes
    total = int(ends[-1]) if len(ends) else w.n
    words = np.zeros((total >> 5) + 3, np.uint64)
    at, shift = starts >> 5, (starts & 31).astype(np.uint64)
    v = values.astype(np.uint64)
    low = (v << shift) & np.uint64(0xFFFFFFFF)
    mid = (v >> (np.uint64(32) - shift)) & np.uint64(0xFFFFFFFF)
    high = np.where(shift > 0, v >> np.uint64(1) >> (np.uint64(63) - shift), np.uint64(0)) & np.uint64(0xFFFFFFFF)
    # Bits of different values never overlap, so a sum by word is their union; a word's values stand side by side.
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    first = np.flatnonzero(new)
    for part, off in ((low, 0), (mid, 1), (high, 2)):
        words[at[first] + off] += np.add.reduceat(part, first)
    body = words.astype("<u4").tobytes()
    w.value |= int.from_bytes(body, "little")
    w.n = total


def write_literals(w: BitWriter, argb: np.ndarray, shared: bool = False) -> None:
    """Code lengths and pixels of one image without cache or back-references. `shared`: one code serves red, green and blue."""
    c = [((argb >> np.uint32(s)) & np.uint32(255)).astype(np.int64) for s in (8, 16, 0, 24)]
    counts = [np.bincount(x, minlength=256) for x in c]
    if shared:
        both = huffman_lengths(counts[0] + counts[1] + counts[2])
        lengths = [both, both, both, huffman_lengths(counts[3])]
    else:
        lengths = [huffman_lengths(n) for n in counts]
    for n, alphabet in zip(lengths, (280, 256, 256, 256), strict=True):
        write_code(w, np.concatenate([n, np.zeros(alphabet - 256, np.int64)]))
    write_code(w, np.zeros(40, np.int64))
    value, size = np.zeros(len(argb), np.int64), np.zeros(len(argb), np.int64)
    for x, n in zip(c, lengths, strict=True):
        if np.count_nonzero(n) > 1:
            value |= canonical(n)[x] << size
            size += n[x]
    _pack(w, value, size)


def write_general(w: BitWriter, argb: np.ndarray, width: int, cache_bits: int, references: bool, main: bool = True) -> None:
    """Literals, colour-cache hits and back-references (longest match at the last place of each triple of pixels)."""
    px, n = argb.tolist(), len(argb)
    shift = 32 - cache_bits
    cache, seen, events, i = [0] * (1 << cache_bits if cache_bits else 0), {}, [], 0
    near = near_distances()
    codes = {}
    for k, (dx, dy) in enumerate(near):
        codes.setdefault(max(1, dx + dy * width), k + 1)
    slot = lambda v: (CACHE_MULTIPLIER * v & 0xFFFFFFFF) >> shift
    while i < n:
        length, d = 0, 0
        if references and i + 3 <= n and (j := seen.get(tuple(px[i : i + 3]))) is not None:
            d = i - j
            while length < 4096 and i + length < n and px[i + length] == px[i + length - d]:
                length += 1
        if length >= 3:
            events.append(("copy", length, codes.get(d, d + 120)))
        elif cache_bits and cache[slot(px[i])] == px[i]:
            events.append(("cache", slot(px[i]), 0))
            length = 1
        else:
            events.append(("pixel", px[i], 0))
            length = 1
        for k in range(i, i + length):
            if cache_bits:
                cache[slot(px[k])] = px[k]
            if references and k + 3 <= n:
                seen[tuple(px[k : k + 3])] = k
        i += length
    counts = [np.zeros(k, np.int64) for k in (280 + len(cache), 256, 256, 256, 40)]
    for kind, a, b in events:
        if kind == "pixel":
            for t, s in enumerate((8, 16, 0, 24)):
                counts[t][a >> s & 255] += 1
        elif kind == "cache":
            counts[0][280 + a] += 1
        else:
            counts[0][256 + prefix_of(a)[0]] += 1
            counts[4][prefix_of(b)[0]] += 1
    lengths = [huffman_lengths(k) for k in counts]
    for k in lengths:
        write_code(w, k)
    table = [canonical(k) for k in lengths]
    bits = [np.where(np.count_nonzero(k) > 1, k, 0) for k in lengths]

    def put(t: int, s: int) -> None:
        if bits[t][s]:
            w.write(int(table[t][s]), int(bits[t][s]))

    for kind, a, b in events:
        if kind == "pixel":
            for t, s in enumerate((8, 16, 0, 24)):
                put(t, a >> s & 255)
        elif kind == "cache":
            put(0, 280 + a)
        else:
            for t, base, v in ((0, 256, a), (4, 0, b)):
                s, extra, rest = prefix_of(v)
                put(t, base + s)
                w.write(rest, extra)


def encode(pixels: np.ndarray, transforms: tuple[int, ...] = (), cache_bits: int = 0, references: bool = False, block_bits: int = 2, shared: bool = True, extra: tuple[tuple[bytes, bytes], ...] = (), seed: int = 0) -> bytes:
    """A lossless WebP file of [height, width, 4] pixels (alpha, red, green, blue). `extra`: further RIFF chunks (name, data)."""
    height, width, _ = pixels.shape
    if not (0 < width <= SIDE and 0 < height <= SIDE):
        raise ValueError("an image side must have 1 to 16384 pixels")
    w = BitWriter()
    w.write(0x2F, 8)
    w.write(width - 1, 14)
    w.write(height - 1, 14)
    w.write(int(bool((pixels[..., 0] != 255).any())), 1)
    w.write(0, 3)
    c, rng, inner = pixels.astype(np.int64), np.random.default_rng(seed), width
    for kind in transforms:
        w.write(1, 1)
        w.write(kind, 2)
        if kind == SUBTRACT_GREEN:
            c[..., 1] = (c[..., 1] - c[..., 2]) & 255
            c[..., 3] = (c[..., 3] - c[..., 2]) & 255
        elif kind == PALETTE:
            argb = _words(c)
            colours, index = np.unique(argb, return_inverse=True)
            if len(colours) > 256:
                raise ValueError("a palette holds 256 colours")
            index = index.reshape(argb.shape)
            w.write(len(colours) - 1, 8)
            w.write(0, 1)
            write_literals(w, _words(np.diff(_channels(colours), axis=0, prepend=0) & 255))
            k = bundle(len(colours))
            each, wide = 8 >> k, (inner + (1 << k) - 1) >> k
            padded = np.zeros((height, wide << k), np.int64)
            padded[:, :inner] = index
            green = (padded.reshape(height, wide, 1 << k) << (np.arange(1 << k) * each)).sum(-1)
            c = np.zeros((height, wide, 4), np.int64)
            c[..., 0], c[..., 2] = 255, green
            inner = wide
        else:
            w.write(block_bits - 2, 3)
            shape = ((height + (1 << block_bits) - 1) >> block_bits, (inner + (1 << block_bits) - 1) >> block_bits)
            e = np.zeros((*shape, 4), np.int64)
            e[..., 0] = 255
            if kind == PREDICTOR:
                e[..., 2] = np.arange(shape[0] * shape[1]).reshape(shape) % 14
                c = run_predictor(c, e[..., 2], block_bits, True)
            else:
                e[..., 1:] = rng.integers(0, 256, (*shape, 3))
                c = run_cross_colour(c, e, block_bits, True)
            w.write(0, 1)
            write_literals(w, _words(e).ravel())
    w.write(0, 1)
    argb = _words(c).ravel()
    if cache_bits:
        w.write(1, 1)
        w.write(cache_bits, 4)
    else:
        w.write(0, 1)
    w.write(0, 1)  # one code group
    if cache_bits or references:
        write_general(w, argb, inner, cache_bits, references)
    else:
        write_literals(w, argb, shared)
    body = w.value.to_bytes((w.n + 7) // 8, "little")
    chunks = b"".join(name + struct.pack("<I", len(d)) + d + bytes(len(d) & 1) for name, d in ((b"VP8L", body), *extra))
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WEBP" + chunks


LEAST_MATCH, LONGEST_MATCH = 16, 4096


def matches(flat: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance) of runs of at least 16 samples that stood before, the last time they did; longest from the first place on."""
    n = len(flat)
    if n < 2 * LEAST_MATCH:
        return []
    eight = np.ndarray((n - 7,), "<u8", np.ascontiguousarray(flat).data, strides=(1,))
    key = eight[:-8] * np.uint64(0x9E3779B97F4A7C15) ^ (eight[8:] * np.uint64(0xD1342543DE82EF95) >> np.uint64(7))
    order = np.argsort(key, kind="stable")
    again = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    if not len(again):
        return []
    later, before = order[again + 1], order[again]
    by = np.argsort(later)
    later, before = later[by], before[by]
    found: list[tuple[int, int, int]] = []
    i, m = 0, len(later)
    while i < m:
        p, q, length = int(later[i]), int(before[i]), 0
        while length < LONGEST_MATCH and p + length < n:
            k = min(256, n - p - length, LONGEST_MATCH - length)
            differ = np.flatnonzero(flat[p + length : p + length + k] != flat[q + length : q + length + k])
            length += int(differ[0]) if len(differ) else k
            if len(differ):
                break
        if length >= LEAST_MATCH:
            found.append((p, length, p - q))
            i = int(np.searchsorted(later, p + length))
        else:
            i += 1
    return found


def _with_references(flat: np.ndarray, width: int, found: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code lengths of green and distances, and the values and sizes in bits of literals and back-references in their order."""
    literal = np.ones(len(flat), bool)
    short = {max(1, dx + dy * width): k + 1 for k, (dx, dy) in reversed(list(enumerate(near_distances())))}
    parts = []
    for p, length, d in found:
        literal[p : p + length] = False
        parts.append((*prefix_of(length), *prefix_of(short.get(d, d + 120))))
    ls, le, lv, ds, de, dv = np.array(parts, np.int64).T
    rest = flat[literal].astype(np.int64)
    green = huffman_lengths(np.bincount(rest, minlength=280) + np.bincount(256 + ls, minlength=280))
    far = huffman_lengths(np.bincount(ds, minlength=40))
    g, g_bits, f = canonical(green), green if np.count_nonzero(green) > 1 else np.zeros_like(green), canonical(far)
    f_bits = far if np.count_nonzero(far) > 1 else np.zeros_like(far)
    value, size = g[256 + ls], g_bits[256 + ls]
    for v, n in ((lv, le), (f[ds], f_bits[ds]), (dv, de)):
        value, size = value | v << size, size + n
    order = np.argsort(np.concatenate([np.flatnonzero(literal), [p for p, _, _ in found]]), kind="stable")
    return green, far, np.concatenate([g[rest], value])[order], np.concatenate([g_bits[rest], size])[order]


def encode_gray(samples: np.ndarray) -> bytes:
    """A lossless WebP file of [height, width] 8-bit samples, opaque, in the smallest of three forms: green subtracted, so that only green is left
    to code, as literals alone or with back-references to runs that stood before; or, of 16 grey values at most, a palette whose indices share pixels."""
    height, width = samples.shape
    flat = samples.ravel()
    counts = np.bincount(flat, minlength=256)
    lengths = huffman_lengths(counts)
    plain = int((counts * lengths).sum()) if np.count_nonzero(counts) > 1 else 0
    w = BitWriter()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (0, 4), (1, 1), (SUBTRACT_GREEN, 2), (0, 1), (0, 1), (0, 1)):
        w.write(value, n)
    found = matches(flat) if plain > 512 else []
    coded = _with_references(flat, width, found) if found else None
    if coded is not None and int(coded[3].sum()) + 128 < plain:
        write_code(w, coded[0])
        distances = coded[1]
    else:
        coded = None
        write_code(w, lengths)
    for only in (0, 0, 255):  # red, blue, alpha
        for value, n in ((1, 1), (0, 1), (1, 1), (only, 8)):
            w.write(value, n)
    if coded is not None:
        write_code(w, distances)
        _pack(w, coded[2], coded[3])
    else:
        for value, n in ((1, 1), (0, 1), (1, 1), (0, 8)):
            w.write(value, n)
        if plain:
            _pack(w, canonical(lengths)[flat], lengths[flat])
    body = w.value.to_bytes((w.n + 7) // 8, "little")
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + bytes(len(body) & 1)
    out = b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk
    if 1 < np.count_nonzero(counts) <= 16:
        pixels = np.repeat(samples[:, :, None], 4, axis=2)
        pixels[..., 0] = 255
        other = encode(pixels, (PALETTE,))
        out = min(out, other, key=len)
    return out


def form(data: bytes) -> str:
    """Which of encode_gray()'s forms a file has: literals, references or palette."""
    r = BitReader(data[20:])
    r.read(8 + 14 + 14 + 4 + 1)
    if r.read(2) == PALETTE:
        return "palette"
    r.read(3)
    return "references" if int(read_code(r, 280).symbol.max()) > 255 else "literals"
