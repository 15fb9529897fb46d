"""Lossless WebP (VP8L) images: a decoder for all of the format, and an encoder for byte payloads and test images.

The decoder reads prefix codes, literals, back-references and the colour cache, meta prefix codes, and inverts the
predictor, cross-colour, subtract-green and palette transforms. Where only the green channel is coded, as in stored
payloads, its symbols are found for every bit position at once and then followed from one code to the next, with a stop
at each back-reference.

A payload is written by what it holds: of at most 16 different bytes as a palette with several indices to a pixel, of bytes that
follow from those before or above as differences from them, and what repeats as back-references. A colour cache, subtract-green and
cross-colour gain nothing in one channel: a cached pixel costs what its green does, and there is no red or blue to take anything from.
"""
from __future__ import annotations

import heapq
import struct
from functools import lru_cache

import numpy as np

# fixed values of the format
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7))
LENGTHS, DISTANCES, CACHE_MULTIPLIER = 24, 40, 0x1E35A7BD
PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, PALETTE = range(4)
OPAQUE = 0xFF000000
LONGEST, MOST_SIDE = 15, 1 << 14
MOST_COPY, MOST_BACK = 4096, (1 << 20) - 120
BLACK, LEFT, TOP = range(3)
# of payloads: bytes that must agree to look for a repeat, shortest one written, share of the bits that differences must save
GRAM, SHORTEST, SAVED = 8, 12, 0.05


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data + bytes(8), 0

    def bits(self, n: int) -> int:
        a = self.at
        self.at = a + n
        return (int.from_bytes(self.data[a >> 3:(a >> 3) + 8], "little") >> (a & 7)) & ((1 << n) - 1)


def canonical(lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """(symbol, length, code as it lies in the stream, first bit lowest) in canonical order."""
    out, code, last = [], 0, 0
    for length, symbol in sorted((int(n), int(s)) for s, n in zip(np.flatnonzero(lengths), lengths[np.flatnonzero(lengths)])):
        code <<= length - last
        out.append((symbol, length, int(f"{code:0{length}b}"[::-1], 2)))
        code, last = code + 1, length
    return out


class Prefix:
    """A prefix code as a table over its longest code; ``only`` is the symbol of a code that takes no bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if used.size == 0:
            raise ValueError("a prefix code without symbols")
        self.only = int(used[0]) if used.size == 1 else None
        self.width = 0
        if self.only is None:
            codes = canonical(lengths)
            self.width = codes[-1][1]
            if sum(1 << (self.width - n) for _, n, _ in codes) != 1 << self.width:
                raise ValueError("an incomplete or overfull prefix code")
            self.symbols = np.zeros(1 << self.width, np.int32)
            self.sizes = np.zeros(1 << self.width, np.uint8)
            for symbol, n, code in codes:
                self.symbols[code::1 << n] = symbol
                self.sizes[code::1 << n] = n

    def read(self, r: Reader) -> int:
        if self.only is not None:
            return self.only
        a = r.at
        w = (int.from_bytes(r.data[a >> 3:(a >> 3) + 4], "little") >> (a & 7)) & ((1 << self.width) - 1)
        r.at = a + int(self.sizes[w])
        return int(self.symbols[w])


def read_prefix(r: Reader, alphabet: int) -> Prefix:
    lengths = np.zeros(alphabet, np.int64)
    if r.bits(1):
        two = r.bits(1)
        first = r.bits(8 if r.bits(1) else 1)
        lengths[first] = 1
        if two:
            lengths[r.bits(8)] = 1
        return Prefix(lengths)
    own = np.zeros(19, np.int64)
    for i in range(4 + r.bits(4)):
        own[CODE_LENGTH_ORDER[i]] = r.bits(3)
    code = Prefix(own)
    left = 2 + r.bits(2 + 2 * r.bits(3)) if r.bits(1) else alphabet
    at, before = 0, 8
    while at < alphabet and left:
        left -= 1
        s = code.read(r)
        if s < 16:
            lengths[at] = s
            at += 1
            before = s or before
        else:
            n = 3 + r.bits(2) if s == 16 else 3 + r.bits(3) if s == 17 else 11 + r.bits(7)
            if at + n > alphabet:
                raise ValueError("code lengths beyond the alphabet")
            lengths[at:at + n] = before if s == 16 else 0
            at += n
    return Prefix(lengths)


def _value(r: Reader, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + r.bits(extra) + 1


def _back(code: int, w: int) -> int:
    return code - 120 if code > 120 else max(1, NEAR[code - 1][0] + NEAR[code - 1][1] * w)


def _green_only(r: Reader, codes: list[Prefix], n: int, w: int) -> np.ndarray:
    """The pixels where only green takes bits: symbol and size at every bit, then one jump per pixel up to the next copy."""
    green, red, blue, alpha, distance = codes
    base = alpha.only << 24 | red.only << 16 | blue.only
    if green.only is not None:
        return np.full(n, base | green.only << 8, np.uint32)
    copying = green.symbols >= 256
    start = r.at >> 3
    raw = np.frombuffer(r.data, np.uint8, offset=start)
    raw = (raw if copying.any() else raw[:(n * green.width >> 3) + 8]).astype(np.uint32)
    words = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    windows = ((words[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32((1 << green.width) - 1)).ravel()
    jump = np.where(copying, 0, green.sizes).astype(np.uint8)[windows].tobytes()
    at, places, done, copies = r.at & 7, [], 0, []
    put = places.append
    try:
        while done < n:
            before = len(places)
            for _ in range(n - done):
                step = jump[at]
                if not step:
                    break
                put(at)
                at += step
            done += len(places) - before
            if done < n:
                r.at = start * 8 + at
                length = _value(r, green.read(r) - 256)
                back = _back(_value(r, distance.read(r)), w)
                if back > done or done + length > n:
                    raise ValueError("a back-reference out of the image")
                copies.append((done, length, back))
                done += length
                at = r.at - start * 8
    except IndexError:
        raise ValueError("the image's data ends early") from None
    r.at = start * 8 + at
    values = green.symbols[windows[places]].astype(np.uint8)
    if copies:
        out, taken, end = np.empty(n, np.uint8), 0, 0
        for to, length, back in copies:
            out[end:to] = values[taken:taken + to - end]
            taken, end = taken + to - end, to + length
            source = out[to - back:min(to, to - back + length)]
            out[to:end] = source if source.size == length else np.resize(source, length)
        out[end:] = values[taken:]
        values = out
    return values.astype(np.uint32) << np.uint32(8) | np.uint32(base)


def read_pixels(r: Reader, w: int, h: int, main: bool) -> np.ndarray:
    """The entropy-coded pixels of an image, or of one that a transform needs."""
    cache_bits = r.bits(4) if r.bits(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    meta, bits, across = None, 0, 0
    if main and r.bits(1):
        bits = r.bits(3) + 2
        across = -(-w >> bits)
        meta = (read_pixels(r, across, -(-h >> bits), False) >> 8 & 0xFFFF).tolist()
    size = 1 << cache_bits if cache_bits else 0
    groups = [[read_prefix(r, a) for a in (256 + LENGTHS + size, 256, 256, 256, DISTANCES)] for _ in range(1 + max(meta or [0]))]
    total = w * h
    one = groups[0]
    if len(groups) == 1 and not size and all(c.only is not None for c in one[1:4]) and \
            (one[0].only < 256 if one[0].only is not None else main or int(one[0].symbols.max()) < 256):
        return _green_only(r, one, total, w)
    pixels, cache, shift = [0] * total, [0] * size, 32 - cache_bits
    at = 0
    while at < total:
        green, red, blue, alpha, distance = groups[meta[(at // w >> bits) * across + (at % w >> bits)]] if meta else one
        s = green.read(r)
        if s < 256:
            rv, bv = red.read(r), blue.read(r)
            new = [alpha.read(r) << 24 | rv << 16 | s << 8 | bv]
        elif s < 256 + LENGTHS:
            n = _value(r, s - 256)
            back = _back(_value(r, distance.read(r)), w)
            if back > at or at + n > total:
                raise ValueError("a back-reference out of the image")
            new = [pixels[at - back + i % back] for i in range(n)]
        else:
            new = [cache[s - 256 - LENGTHS]]
        pixels[at:at + len(new)] = new
        at += len(new)
        if size:
            for p in new:
                cache[(CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> shift] = p
    return np.array(pixels, np.uint32)


def _channels(argb: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(argb, "<u4").view(np.uint8).reshape(*argb.shape, 4).astype(np.int64)     # b g r a


def _joined(channels: np.ndarray) -> np.ndarray:
    return (channels & 255).astype(np.uint8).reshape(*channels.shape[:-1], 4).view("<u4")[..., 0]


def _predict(mode: int, left, top, right, corner) -> list[int]:
    """The prediction per channel from the neighbours: left, top, top right and top left."""
    mean = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b)]
    clamp = lambda x: 0 if x < 0 else 255 if x > 255 else x
    if mode in (1, 2, 3, 4):
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return mean(mean(left, right), top)
    if mode in (6, 7, 8, 9):
        return mean(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return mean(mean(left, corner), mean(top, right))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, corner))
        to_top = sum(abs(x - c) for x, c in zip(left, corner))
        return left if to_left < to_top else top
    if mode == 12:
        return [clamp(x + t - c) for x, t, c in zip(left, top, corner)]
    if mode == 13:
        return [clamp(m + int((m - c) / 2)) for m, c in zip(mean(left, top), corner)]
    return [0, 0, 0, 255]


def _predictor(argb: np.ndarray, modes: np.ndarray, bits: int, forward: bool) -> np.ndarray:
    h, w = argb.shape
    if not forward and h and modes.min() == modes.max() and modes.min() in (LEFT, TOP):
        sums = _channels(argb)
        sums[0, 0, 3] += 255                    # black comes before the first pixel
        along = int(modes.min() == LEFT)        # the first row is told from the left, the first column from above
        edge = sums[:, 0] if along else sums[0]
        edge[:] = np.cumsum(edge, axis=0)
        return _joined(np.cumsum(sums, axis=along))
    given = _channels(argb).tolist()
    out = [[None] * w for _ in range(h)]
    true = given if forward else out
    for y in range(h):
        for x in range(w):
            if x == 0 and y == 0:
                p = [0, 0, 0, 255]
            elif y == 0:
                p = true[0][x - 1]
            elif x == 0:
                p = true[y - 1][0]
            else:
                right = true[y - 1][x + 1] if x + 1 < w else true[y][0]
                p = _predict(int(modes[y >> bits, x >> bits]), true[y][x - 1], true[y - 1][x], right, true[y - 1][x - 1])
            v = given[y][x]
            out[y][x] = [(a - b if forward else a + b) & 255 for a, b in zip(v, p)]
    return _joined(np.array(out, np.int64).reshape(h, w, 4))


def _signed(x: np.ndarray) -> np.ndarray:
    x = x & 255
    return np.where(x > 127, x - 256, x)


def _cross_color(argb: np.ndarray, elements: np.ndarray, bits: int, forward: bool) -> np.ndarray:
    h, w = argb.shape
    e = _channels(elements)[np.arange(h)[:, None] >> bits, np.arange(w)[None, :] >> bits]
    c = _channels(argb)
    delta = lambda t, v: (_signed(t) * _signed(v)) >> 5
    sign = -1 if forward else 1
    red = c[..., 2] + sign * delta(e[..., 0], c[..., 1])
    true_red = c[..., 2] if forward else red
    blue = c[..., 0] + sign * (delta(e[..., 1], c[..., 1]) + delta(e[..., 2], true_red))
    return _joined(np.stack([blue, c[..., 1], red, c[..., 3]], axis=-1))


def _green(argb: np.ndarray, sign: int) -> np.ndarray:
    c = _channels(argb)
    c[..., 0] += sign * c[..., 1]
    c[..., 2] += sign * c[..., 1]
    return _joined(c)


def _bundle_bits(colors: int) -> int:
    return 3 if colors <= 2 else 2 if colors <= 4 else 1 if colors <= 16 else 0


def _from_palette(argb: np.ndarray, table: np.ndarray, w: int) -> np.ndarray:
    wb = _bundle_bits(table.size)
    x = np.arange(w)
    index = (argb[:, x >> wb] >> 8 & 255) >> ((x & ((1 << wb) - 1)) * (8 >> wb)).astype(np.uint32) & np.uint32((1 << (8 >> wb)) - 1)
    return np.concatenate([table, np.zeros(256, np.uint32)]).astype(np.uint32)[index]


def decode(data: bytes) -> np.ndarray:
    """The ARGB pixels (height, width) of one WebP file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20:21] != b"\x2f":
        raise ValueError("not a lossless WebP file")
    r = Reader(data[21:20 + struct.unpack("<I", data[16:20])[0]])
    width, h = r.bits(14) + 1, r.bits(14) + 1
    r.bits(1)
    if r.bits(3):
        raise ValueError("unknown version")
    w, undo, seen = width, [], set()
    while r.bits(1):
        kind = r.bits(2)
        if kind in seen:
            raise ValueError("a transform given twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOR):
            bits = r.bits(3) + 2
            sub = read_pixels(r, -(-w >> bits), -(-h >> bits), False).reshape(-(-h >> bits), -1)
            if kind == PREDICTOR:
                undo.append(lambda a, m=sub >> 8 & 15, b=bits: _predictor(a, m, b, False))
            else:
                undo.append(lambda a, e=sub, b=bits: _cross_color(a, e, b, False))
        elif kind == SUBTRACT_GREEN:
            undo.append(lambda a: _green(a, 1))
        else:
            size = r.bits(8) + 1
            table = _joined(np.cumsum(_channels(read_pixels(r, size, 1, False)), axis=0))
            undo.append(lambda a, t=table, n=w: _from_palette(a, t, n))
            w = -(-w >> _bundle_bits(size))
    argb = read_pixels(r, w, h, True).reshape(h, w)
    if r.at > 8 * (len(r.data) - 8):
        raise ValueError("the image's data ends early")
    for f in reversed(undo):
        argb = f(argb)
    return argb


# ---------------------------------------------------------------------------------------------------- encoding
class Writer:
    def __init__(self):
        self.value, self.n = 0, 0

    def bits(self, v: int, n: int) -> None:
        self.value |= v << self.n
        self.n += n


def code_lengths(counts: np.ndarray, longest: int) -> np.ndarray:
    """Huffman code lengths, none above ``longest``: small counts are raised until that holds."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(counts.size, np.int64)
    if used.size < 2:
        lengths[used] = 1
        return lengths
    least = 1
    while True:
        heap = [(max(int(counts[s]), least), i) for i, s in enumerate(used)]
        heapq.heapify(heap)
        parent, new = {}, used.size
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            parent[a[1]] = parent[b[1]] = new
            heapq.heappush(heap, (a[0] + b[0], new))
            new += 1
        depth = {new - 1: 0}
        for i in range(new - 2, -1, -1):
            depth[i] = depth[parent[i]] + 1
        own = [depth[i] for i in range(used.size)]
        if max(own) <= longest:
            lengths[used] = own
            return lengths
        least = max(least * 2, int(counts.sum()) >> longest)


def write_only(w: Writer, symbol: int) -> None:
    """Write a code of one symbol, which takes no bits."""
    w.bits(0b101 | symbol << 3, 11)


def write_prefix(w: Writer, lengths: np.ndarray) -> dict[int, tuple[int, int]]:
    """Write a code's lengths; gives symbol -> (bits in stream order, number)."""
    used = np.flatnonzero(lengths)
    if used.size <= 1 and (not used.size or used[0] < 256):
        write_only(w, int(used[0]) if used.size else 0)
        return {int(s): (0, 0) for s in used}
    tokens, at = [], 0
    for s, n in [*zip(used.tolist(), lengths[used].tolist()), (lengths.size, None)]:
        gap = s - at
        while gap >= 3:
            run = min(gap, 138)
            tokens.append((17, run - 3, 3) if run < 11 else (18, run - 11, 7))
            gap -= run
        tokens += [(0, 0, 0)] * gap
        if n is not None:
            tokens.append((n, 0, 0))
        at = s + 1
    own = code_lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)
    if np.count_nonzero(own) == 1:              # a lone symbol takes no bits; give it a partner, as codes must be whole
        own[[s for s in (0, 1) if not own[s]][0]] = 1
    order = [int(own[s]) for s in CODE_LENGTH_ORDER]
    n = max(4, 1 + max(i for i, v in enumerate(order) if v))
    w.bits(0, 1)
    w.bits(n - 4, 4)
    for v in order[:n]:
        w.bits(v, 3)
    w.bits(0, 1)
    codes = {s: (c, k) for s, k, c in canonical(own)}
    for s, extra, k in tokens:
        w.bits(*codes[s])
        w.bits(extra, k)
    if used.size == 1:
        return {int(used[0]): (0, 0)}
    return {s: (c, k) for s, k, c in canonical(lengths)}


def container(stream: bytes) -> bytes:
    body = b"VP8L" + struct.pack("<I", len(stream)) + stream + bytes(len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body


def _head(w: Writer, width: int, height: int, alpha: bool) -> None:
    w.bits(0x2F, 8)
    w.bits(width - 1, 14)
    w.bits(height - 1, 14)
    w.bits(int(alpha), 1)
    w.bits(0, 3)


def _prefix_of(value: int) -> tuple[int, int, int]:
    """(prefix, extra bits' value, their number) of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    extra = top - 1
    return 2 * top + (v >> extra & 1), v & ((1 << extra) - 1), extra


@lru_cache(8)
def _near(w: int) -> dict[int, int]:
    """Distance -> its code, the smallest, of the near ones in an image of that width."""
    out: dict[int, int] = {}
    for i in range(len(NEAR)):
        out.setdefault(_back(i + 1, w), i + 1)
    return out


def _tokens(argb: np.ndarray, w: int, cache_bits: int, copies: bool) -> list[tuple]:
    """Literals, cache hits and copies of at least three pixels, found by the last place of the same three."""
    px, out, last, at = argb.ravel().tolist(), [], {}, 0
    cache = [0] * (1 << cache_bits) if cache_bits else []
    near = _near(w)
    while at < len(px):
        key, n = tuple(px[at:at + 3]), 0
        if copies and len(key) == 3 and key in last:
            back = at - last[key]
            while at + n < len(px) and n < 4096 and px[at + n] == px[at + n - back]:
                n += 1
        slot = (CACHE_MULTIPLIER * px[at] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        if n >= 3:
            out.append(("copy", n, near.get(back, back + 120)))
        elif cache and cache[slot] == px[at] and at:
            n = 1
            out.append(("cache", slot))
        else:
            n = 1
            out.append(("pixel", px[at]))
        for i in range(at, at + n):
            last[tuple(px[i:i + 3])] = i
            if cache:
                cache[(CACHE_MULTIPLIER * px[i] & 0xFFFFFFFF) >> (32 - cache_bits)] = px[i]
        at += n
    return out


def _write_pixels(w: Writer, argb: np.ndarray, cache_bits: int, copies: bool, main: bool, group_bits: int = 0) -> None:
    h, width = argb.shape
    w.bits(int(cache_bits > 0), 1)
    if cache_bits:
        w.bits(cache_bits, 4)
    tokens = _tokens(argb, width, cache_bits, copies)
    group = lambda at: 0
    n_groups = 1
    if main:
        w.bits(int(group_bits > 0), 1)
        if group_bits:                          # two code groups, laid out as a chessboard
            across, down = -(-width >> group_bits), -(-h >> group_bits)
            board = (np.add.outer(np.arange(down), np.arange(across)) & 1).astype(np.uint32)
            w.bits(group_bits - 2, 3)
            _write_pixels(w, board << np.uint32(8), 0, False, False)
            n_groups = int(board.max()) + 1
            group = lambda at: int(board[at // width >> group_bits, at % width >> group_bits])
    sizes = (256 + LENGTHS + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, DISTANCES)
    counts = [[np.zeros(s, np.int64) for s in sizes] for _ in range(n_groups)]
    planned, at = [], 0
    for t in tokens:
        g = group(at)
        if t[0] == "pixel":
            p = t[1]
            parts = [(0, p >> 8 & 255, 0, 0), (1, p >> 16 & 255, 0, 0), (2, p & 255, 0, 0), (3, p >> 24, 0, 0)]
            at += 1
        elif t[0] == "cache":
            parts = [(0, 256 + LENGTHS + t[1], 0, 0)]
            at += 1
        else:
            (a, av, an), (d, dv, dn) = _prefix_of(t[1]), _prefix_of(t[2])
            parts = [(0, 256 + a, av, an), (4, d, dv, dn)]
            at += t[1]
        for k, s, _, _ in parts:
            counts[g][k][s] += 1
        planned.append((g, parts))
    codes = [[write_prefix(w, code_lengths(c, LONGEST)) for c in own] for own in counts]
    for g, parts in planned:
        for k, s, extra, n in parts:
            w.bits(*codes[g][k][s])
            w.bits(extra, n)


def _write_palette(w: Writer, table: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Write a palette; gives the indices as they lie in the pixels, several to one if there are few."""
    w.bits(table.size - 1, 8)
    steps = _channels(table)
    _write_pixels(w, _joined(np.diff(steps, axis=0, prepend=0))[None, :], 0, True, False)
    wb = _bundle_bits(table.size)
    packed = np.zeros((index.shape[0], -(-index.shape[1] >> wb)), np.uint32)
    for x in range(1 << wb):
        part = index[:, x::1 << wb]
        packed[:, :part.shape[1]] |= (part << (x * (8 >> wb))).astype(np.uint32)
    return packed


def _entropy(counts: np.ndarray) -> float:
    """Bits that symbols of these counts take at least."""
    c = counts[counts > 0]
    return float((c * np.log2(c.sum() / c)).sum())


def _differences(image: np.ndarray, mode: int) -> np.ndarray:
    """Bytes less those to the left or above; the first row has only a left, the first column only an above."""
    out = image.copy()
    out[0, 1:] -= image[0, :-1]
    out[1:, 0] -= image[:-1, 0]
    out[1:, 1:] -= image[1:, :-1] if mode == LEFT else image[:-1, 1:]
    return out


def repeats(a: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance) of stretches that came before, from left to right and without overlap."""
    n = a.size - GRAM + 1
    if n < 2:
        return []
    grams = np.ndarray((n,), "<u8", a.tobytes(), strides=(1,)).copy()
    low = np.uint64((1 << 20) - 1)              # no image has more pixels, so a place fits beside 44 bits of hash
    sort = grams * np.uint64(0x9E3779B97F4A7C15) & ~low | np.arange(n, dtype=np.uint64)
    sort.sort()
    met = np.flatnonzero((sort[1:] ^ sort[:-1]) <= low)
    if not met.size:
        return []
    place = (sort & low).astype(np.int64)
    later, earlier = place[met + 1], place[met]
    real = (grams[later] == grams[earlier]) & (later - earlier <= MOST_BACK)
    back = np.zeros(n, np.int64)
    back[later[real]] = (later - earlier)[real]
    at = np.flatnonzero(back)
    if not at.size:
        return []
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (back[at[1:]] != back[at[:-1]])])
    length = np.diff(np.r_[first, at.size]) + GRAM - 1
    first, length = first[length >= SHORTEST], length[length >= SHORTEST]
    out, end = [], 0
    for to, size, distance in zip(at[first].tolist(), length.tolist(), back[at[first]].tolist()):
        stop, to = to + size, max(to, end)
        if stop - to >= SHORTEST:
            out += [(x, min(MOST_COPY, stop - x), distance) for x in range(to, stop, MOST_COPY)]
            end = stop
    return out


def encode_bytes(payload: bytes, width: int = 64, longest: int = 12) -> bytes:
    """One image with a byte per pixel, in green; the other channels are constant and take no bits. Palette, differences and
    copies are used where the payload gains by them."""
    a = np.frombuffer(payload, np.uint8)
    height = a.size // width
    if a.size != width * height or not 0 < height <= MOST_SIDE:
        raise ValueError("a payload must fill whole rows of one image")
    w = Writer()
    _head(w, width, height, False)
    across, alpha, counts = width, 255, np.bincount(a, minlength=256)
    colours = np.flatnonzero(counts)
    if _bundle_bits(colours.size):
        w.bits(1, 1)
        w.bits(PALETTE, 2)
        number = np.zeros(256, np.int64)
        number[colours] = np.arange(colours.size)
        packed = _write_palette(w, colours.astype(np.uint32) << np.uint32(8) | np.uint32(OPAQUE), number[a].reshape(height, width))
        a, across = packed.astype(np.uint8).ravel(), packed.shape[1]
    else:
        image = a.reshape(height, width)
        told = {mode: _differences(image, mode).ravel() for mode in (LEFT, TOP)}
        bits = {mode: _entropy(np.bincount(x, minlength=256)) for mode, x in told.items()}
        mode = min(bits, key=bits.get)
        if bits[mode] < (1 - SAVED) * _entropy(counts):
            a, alpha = told[mode], 0
            w.bits(1, 1)
            w.bits(PREDICTOR, 2)
            w.bits(7, 3)                        # blocks of 512 pixels, the largest
            _write_pixels(w, np.full((-(-height >> 9), -(-width >> 9)), mode << 8, np.uint32), 0, False, False)
    w.bits(0, 3)                                # no more transforms, no colour cache, one code group
    copies, kept = repeats(a) if a.min() < a.max() else [], np.ones(a.size, bool)
    near, parts = _near(across), []
    for at, n, back in copies:
        kept[at:at + n] = False
        parts.append((_prefix_of(n), _prefix_of(near.get(back, back + 120))))
    left = np.flatnonzero(kept)
    a = a[left]
    counts = np.bincount([256 + x[0] for x, _ in parts], minlength=256 + LENGTHS) if parts else np.zeros(256 + LENGTHS, np.int64)
    counts[:256] = np.bincount(a, minlength=256)
    codes = write_prefix(w, code_lengths(counts, longest))
    for only in (0, 0, alpha):                  # red, blue, alpha
        write_only(w, only)
    far = write_prefix(w, code_lengths(np.bincount([x[0] for _, x in parts] or [0], minlength=DISTANCES), longest))
    code, size = np.zeros(256 + LENGTHS, np.uint64), np.zeros(256 + LENGTHS, np.int64)
    for s, (c, n) in codes.items():
        code[s], size[s] = c, n
    values, sizes = code[a], size[a]
    if parts:                                   # a copy is two numbers: its length and its distance, each with its extra bits
        pairs = [(codes[256 + s], e, n) for (s, e, n), _ in parts], [(far[s], e, n) for _, (s, e, n) in parts]
        numbers = np.array([[c | e << k for (c, k), e, _ in x] for x in pairs], np.uint64).T.ravel()
        widths = np.array([[k + n for (_, k), _, n in x] for x in pairs], np.int64).T.ravel()
        before = np.repeat(np.searchsorted(left, [x[0] for x in copies]), 2)
        values, sizes = np.insert(values, before, numbers), np.insert(sizes, before, widths)
    ends = np.cumsum(sizes) + (w.n & 31)
    places = ends - sizes
    words = np.zeros((int(ends[-1]) >> 5) + 2, np.uint64)
    if sizes.any():                             # a number is shorter than a word, so it ends in this word or the next
        word = places >> 5
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        sums = np.add.reduceat(values << (places & 31).astype(np.uint64), first)
        words[word[first]] += sums & np.uint64(0xFFFFFFFF)
        words[word[first] + 1] += sums >> np.uint64(32)
    start = w.n >> 5
    tail = w.value >> (32 * start)
    words[0] |= np.uint64(tail)
    bits = w.n + int(sizes.sum())
    stream = (w.value & ((1 << 32 * start) - 1)).to_bytes(4 * start, "little") + words.astype("<u4").tobytes()
    return container(stream[:-(-bits // 8)])


def encode(argb: np.ndarray, transforms: tuple = (), cache_bits: int = 0, copies: bool = True, group_bits: int = 0, block_bits: int = 2,
           seed: int = 0) -> bytes:
    """An image with the given transforms in order; predictor modes and colour elements are drawn, as any are valid."""
    h, width = argb.shape
    rng = np.random.default_rng(seed)
    w = Writer()
    _head(w, width, h, True)
    for kind in transforms:
        w.bits(1, 1)
        w.bits(kind, 2)
        shape = (-(-argb.shape[0] >> block_bits), -(-argb.shape[1] >> block_bits))
        if kind in (PREDICTOR, CROSS_COLOR):
            w.bits(block_bits - 2, 3)
            if kind == PREDICTOR:
                modes = rng.integers(0, 14, shape).astype(np.uint32)
                _write_pixels(w, modes << np.uint32(8), 0, True, False)
                argb = _predictor(argb, modes, block_bits, True)
            else:
                elements = rng.integers(0, 1 << 24, shape).astype(np.uint32)
                _write_pixels(w, elements, 0, True, False)
                argb = _cross_color(argb, elements, block_bits, True)
        elif kind == SUBTRACT_GREEN:
            argb = _green(argb, -1)
        else:
            table, index = np.unique(argb, return_inverse=True)
            if table.size > 256:
                raise ValueError("more than 256 colours")
            packed = _write_palette(w, table.astype(np.uint32), index.reshape(argb.shape))
            argb = packed << np.uint32(8) | np.uint32(OPAQUE)
    w.bits(0, 1)
    _write_pixels(w, argb.astype(np.uint32), cache_bits, copies, True, group_bits)
    return container(w.value.to_bytes(-(-w.n // 8), "little"))
