"""Lossless WebP (VP8L): an encoder and a decoder of single images as arrays of 32-bit ARGB pixels.

Decoder: prefix codes (simple and normal, with the repeat codes of code lengths), LZ77 back-references with the plane
distance map, the colour cache, several code groups chosen by an entropy image, and the inverse of all four transforms
(predictor, cross-colour, subtract-green, colour-indexing). Images of literals alone are decoded by arrays: the codes
that would start at every bit are looked up at once, and only the chain of pixel starts is followed step by step.

Encoder: canonical prefix codes limited to 15 bits, optional transforms, back-references and colour cache (``Tools``, of
which ``tools_for`` picks some by an image's content).
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np

SIDE = 16384
_CHANNELS = ((8, 0xFF), (16, 0xFF), (0, 0xFF), (24, 0xFF))  # green, red, blue, alpha

# Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_MULTIPLIER = 0x1E35A7BD
DISTANCE_MAP = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, COLOUR_INDEXING = range(4)
#: The predictor mode that guesses the pixel above.
TOP = 2


# ---- prefix codes ----


def code_lengths(counts: np.ndarray, most: int = 15) -> np.ndarray:
    """Lengths of a prefix code for ``counts``, at most ``most`` bits: counts are raised until the tree is flat enough."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    floor = 1
    while True:
        heap = [(max(int(counts[s]), floor), int(s)) for s in used]
        heapq.heapify(heap)
        parent: dict[int, int] = {}
        fresh = len(counts)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            parent[a[1]] = parent[b[1]] = fresh
            heapq.heappush(heap, (a[0] + b[0], fresh))
            fresh += 1
        depth = {fresh - 1: 0}
        for node in range(fresh - 2, len(counts) - 1, -1):
            depth[node] = depth[parent[node]] + 1
        lengths[used] = [depth[parent[int(s)]] + 1 for s in used]
        if lengths.max() <= most:
            return lengths
        floor = max(2 * floor, int(counts.sum()) >> most)


def _reversals(bits: int) -> np.ndarray:
    """Every number of ``bits`` bits read backwards."""
    out = np.zeros(1, np.int64)
    for _ in range(bits):
        out = np.concatenate([2 * out, 2 * out + 1])
    return out


_REVERSED = _reversals(15)


def _reverse(values: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
    return _REVERSED[values] >> (15 - bits)


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by ascending length, then symbol; first bit lowest, as they are read."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes = np.zeros(len(lengths), np.int64)
    if len(order):
        own = lengths[order]
        top = int(own[-1])
        before = np.concatenate([[0], np.cumsum(1 << (top - own))[:-1]])
        codes[order] = _reverse(before >> (top - own), own)
    return codes


class _Table:
    """Lookup of the symbol and length of the code at the start of ``bits`` bits."""

    def __init__(self, lengths: np.ndarray) -> None:
        used = np.flatnonzero(lengths)
        if len(used) < 2:
            self.bits = 0
            self.symbol, self.length = np.array([used[0] if len(used) else 0]), np.zeros(1, np.int64)
        else:
            self.bits = int(lengths.max())
            if int((1 << (self.bits - lengths[used])).sum()) != 1 << self.bits:
                raise ValueError("the prefix code is not complete")
            self.symbol, self.length = np.zeros(1 << self.bits, np.int64), np.zeros(1 << self.bits, np.int64)
            order = used[np.lexsort((used, lengths[used]))]
            spread = np.repeat(order, 1 << (self.bits - lengths[order]))
            place = _reverse(np.arange(1 << self.bits), self.bits)
            self.symbol[place], self.length[place] = spread, lengths[spread]
        self.mask = (1 << self.bits) - 1

    def lists(self) -> tuple[list[int], list[int]]:
        if not hasattr(self, "_lists"):
            self._lists = self.symbol.tolist(), self.length.tolist()
        return self._lists


# ---- bits ----


class _Writer:
    def __init__(self) -> None:
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.waiting: list[tuple[int, int]] = []

    def put(self, value: int, bits: int) -> None:
        self.waiting.append((value, bits))

    def many(self, values: np.ndarray, bits: np.ndarray) -> None:
        self.flush()
        self.values.append(values)
        self.sizes.append(bits)

    def flush(self) -> None:
        if self.waiting:
            both = np.array(self.waiting, np.int64)
            self.waiting = []
            self.values.append(both[:, 0])
            self.sizes.append(both[:, 1])

    def append(self, other: _Writer) -> None:
        self.flush()
        other.flush()
        self.values += other.values
        self.sizes += other.sizes

    def done(self) -> bytes:
        self.flush()
        values, sizes = np.concatenate(self.values).astype(np.uint64), np.concatenate(self.sizes)
        values, sizes = values[sizes > 0], sizes[sizes > 0]
        ends = np.cumsum(sizes)
        at = ends - sizes
        word, shifted = at >> 5, values << (at & 31).astype(np.uint64)
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        both = np.bitwise_or.reduceat(shifted, first)
        out = np.zeros(int(ends[-1] >> 5) + 2, np.uint64)
        out[word[first]] |= both & np.uint64(0xFFFFFFFF)
        out[word[first] + 1] |= both >> np.uint64(32)
        return out.astype("<u4").tobytes()[: (int(ends[-1]) + 7) // 8]


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.raw, self.data, self.at = data, data + bytes(16), 0

    def take(self, bits: int) -> int:
        value = int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 8], "little") >> (self.at & 7) & ((1 << bits) - 1)
        self.at += bits
        if self.at > 8 * len(self.raw) + 7:
            raise ValueError("the data end too early")
        return value

    def symbol(self, table: _Table) -> int:
        start = int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 8], "little") >> (self.at & 7) & table.mask
        symbols, lengths = table.lists()
        self.at += lengths[start]
        return symbols[start]


# ---- prefixed numbers (lengths and distances of back-references) ----


def _prefix(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits and their number for a value from 1."""
    value -= 1
    if value < 4:
        return value, 0, 0
    top = value.bit_length() - 1
    second = value >> (top - 1) & 1
    return 2 * top + second, value & ((1 << (top - 1)) - 1), top - 1


def _unprefix(symbol: int, reader: _Reader) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + reader.take(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > len(DISTANCE_MAP):
        return code - len(DISTANCE_MAP)
    x, y = DISTANCE_MAP[code - 1]
    return max(1, x + y * width)


# ---- transforms ----


def _halves(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return pixels & 0x00FF00FF, pixels >> 8 & 0x00FF00FF


def _add(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _subtract(a: int, b: int) -> int:
    return sum((((a >> s & 0xFF) - (b >> s & 0xFF)) & 0xFF) << s for s in (0, 8, 16, 24))


def _average(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _parts(p: int) -> tuple[int, int, int, int]:
    return p >> 24 & 0xFF, p >> 16 & 0xFF, p >> 8 & 0xFF, p & 0xFF


def _join(parts) -> int:
    a, r, g, b = (min(max(x, 0), 255) for x in parts)
    return a << 24 | r << 16 | g << 8 | b


def _select(left: int, top: int, corner: int) -> int:
    to_left = to_top = 0
    for x, y, z in zip(_parts(left), _parts(top), _parts(corner), strict=True):
        guess = x + y - z
        to_left += abs(guess - x)
        to_top += abs(guess - y)
    return left if to_left < to_top else top


def _predict(mode: int, left: int, top: int, corner: int, right: int) -> int:
    """The guess for a pixel from its left, top, top-left and top-right neighbours."""
    match mode:
        case 1:
            return left
        case 2:
            return top
        case 3:
            return right
        case 4:
            return corner
        case 5:
            return _average(_average(left, right), top)
        case 6:
            return _average(left, corner)
        case 7:
            return _average(left, top)
        case 8:
            return _average(corner, top)
        case 9:
            return _average(top, right)
        case 10:
            return _average(_average(left, corner), _average(top, right))
        case 11:
            return _select(left, top, corner)
        case 12:
            return _join(x + y - z for x, y, z in zip(_parts(left), _parts(top), _parts(corner), strict=True))
        case 13:
            mean = _average(left, top)
            return _join(x + int((x - z) / 2) for x, z in zip(_parts(mean), _parts(corner), strict=True))
    return 0xFF000000


def _guessed(pixels: np.ndarray, width: int, height: int, bits: int, modes: np.ndarray, forward: bool) -> np.ndarray:
    """Residuals from pixels (forward) or pixels from residuals; both see the finished neighbours."""
    if (modes >> 8 & 0xF == TOP).all():
        return _from_top(pixels.reshape(height, width), forward).ravel()
    known, out = pixels.tolist(), [0] * len(pixels)
    done = known if forward else out
    across = (width + (1 << bits) - 1) >> bits
    choice = (modes >> 8 & 0xF).tolist()
    for y in range(height):
        row = (y >> bits) * across
        for x in range(width):
            i = y * width + x
            if not i:
                guess = 0xFF000000
            elif not y:
                guess = done[i - 1]
            elif not x:
                guess = done[i - width]
            else:
                guess = _predict(choice[row + (x >> bits)], done[i - 1], done[i - width], done[i - width - 1], done[i - width + 1])
            out[i] = _subtract(known[i], guess) if forward else _add(known[i], guess)
    return np.array(out, np.uint32)


def _from_top(pixels: np.ndarray, forward: bool) -> np.ndarray:
    """The predictor that guesses the pixel above, for whole images: the first row is guessed from the left, the first
    pixel is black. Differences of bytes one way, running sums of bytes the other."""
    channels = np.ascontiguousarray(pixels, "<u4").view(np.uint8).reshape(*pixels.shape, 4)
    black = np.array([0, 0, 0, 0xFF], np.uint8)
    out = channels.copy()
    if forward:
        out[1:] -= channels[:-1]
        out[0, 1:] -= channels[0, :-1]
        out[0, 0] -= black
    else:
        out[0, 0] += black
        out[0] = np.cumsum(out[0], axis=0, dtype=np.uint8)
        out = np.cumsum(out, axis=0, dtype=np.uint8)
    return out.reshape(*pixels.shape[:1], -1).view("<u4").astype(np.uint32)


def _signed(x: np.ndarray) -> np.ndarray:
    return (x & 0xFF).astype(np.uint8).view(np.int8).astype(np.int64)


def _crossed(pixels: np.ndarray, width: int, height: int, bits: int, elements: np.ndarray, sign: int) -> np.ndarray:
    """Add (sign 1) or take away (-1) what red and blue share with green and red, block by block."""
    across = (width + (1 << bits) - 1) >> bits
    y, x = np.divmod(np.arange(width * height), width)
    e = elements[(y >> bits) * across + (x >> bits)]
    p = pixels.astype(np.int64)
    green, red, blue = _signed(p >> 8), p >> 16 & 0xFF, p & 0xFF
    new_red = (red + sign * (_signed(e) * green >> 5)) & 0xFF
    full_red = new_red if sign > 0 else red
    new_blue = (blue + sign * (_signed(e >> 8) * green >> 5) + sign * (_signed(e >> 16) * _signed(full_red) >> 5)) & 0xFF
    return (p & 0xFF00FF00 | new_red << 16 | new_blue).astype(np.uint32)


def _green(pixels: np.ndarray, sign: int) -> np.ndarray:
    p = pixels.astype(np.int64)
    g = p >> 8 & 0xFF
    return (p & 0xFF00FF00 | ((p >> 16 & 0xFF) + sign * g & 0xFF) << 16 | ((p & 0xFF) + sign * g & 0xFF)).astype(np.uint32)


def _packing(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _indexed(pixels: np.ndarray, width: int, height: int, palette: np.ndarray) -> np.ndarray:
    """Colours of packed palette indices."""
    bits = _packing(len(palette))
    narrow = (width + (1 << bits) - 1) >> bits
    each = 8 >> bits
    y, x = np.divmod(np.arange(width * height), width)
    index = pixels.astype(np.int64)[y * narrow + (x >> bits)] >> 8 >> (x & ((1 << bits) - 1)) * each & ((1 << each) - 1)
    full = np.zeros(256, np.uint32)
    full[: len(palette)] = palette
    return full[index]


# ---- decoder ----


def _read_lengths(r: _Reader, size: int) -> tuple[np.ndarray, bool]:
    """Code lengths of an alphabet, and whether the description would read alike for an alphabet of another size."""
    lengths = np.zeros(size, np.int64)
    if r.take(1):
        two, wide = r.take(1), r.take(1)
        lengths[r.take(8 if wide else 1)] = 1
        if two:
            lengths[r.take(8)] = 1
        return lengths, True
    own = np.zeros(19, np.int64)
    for k in LENGTH_ORDER[: 4 + r.take(4)]:
        own[k] = r.take(3)
    table = _Table(own)
    left = size
    stated = bool(r.take(1))
    if stated:
        left = 2 + r.take(2 + 2 * r.take(3))
    # A code and its extra bits take 14 bits at most, so one number holds all that is left to read.
    window = int.from_bytes(r.data[r.at >> 3 : (r.at >> 3) + 2 * size + 8], "little") >> (r.at & 7)
    (symbols, sizes), mask, bit = table.lists(), table.mask, 0
    at, last, found = 0, 8, [0] * size
    while at < size and left:
        left -= 1
        start = window >> bit & mask
        s = symbols[start]
        bit += sizes[start]
        if s < 16:
            found[at] = s
            last = s or last
            at += 1
            continue
        extra, n = {16: (2, 3), 17: (3, 3), 18: (7, 11)}[s]
        n += window >> bit & ((1 << extra) - 1)
        bit += extra
        if at + n > size:
            raise ValueError("code lengths run over")
        if s == 16:
            found[at : at + n] = [last] * n
        at += n
    r.at += bit
    lengths[:] = found
    return lengths, stated and left == 0 and lengths.any()


def _literals(r: _Reader, tables: list[_Table], n: int) -> np.ndarray | None:
    """``n`` pixels if the code has literals only; else None, and the reader stays. The codes that start at every bit are
    looked up as arrays; only the chain from pixel to pixel is followed one by one."""
    if tables[0].symbol.max() >= 256:
        return None
    begin, first = r.at, r.at >> 3
    most = sum(t.bits for t in tables[:4])
    if not most:
        return np.full(n, sum(int(t.symbol[0]) << s for t, (s, _) in zip(tables, _CHANNELS, strict=False)), np.uint32)
    raw = np.frombuffer(r.data, np.uint8)[first : first + (n * most + 7 >> 3) + 16].astype(np.uint32)
    windows = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    at_bit = (windows[:, None] >> np.arange(8, dtype=np.uint32)[None, :]).ravel()
    total = len(at_bit)
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for t in tables[:4]:
        if id(t) not in found:
            start = (at_bit & np.uint32(t.mask)).astype(np.intp)
            found[id(t)] = start, t.length.take(start)
    here = np.arange(total)
    where = here
    for t in tables[:4]:
        where = where + found[id(t)][1].take(where, mode="clip")
    jump = (where - here).astype(np.uint8).tobytes()
    places, at = [], begin - 8 * first
    add = places.append
    for _ in range(n):
        add(at)
        at += jump[at]
    if at > 8 * (len(r.raw) - first):
        raise ValueError("the data end too early")
    spots = np.array(places, np.int64)
    out = np.zeros(n, np.uint32)
    for t, (shift, _) in zip(tables, _CHANNELS, strict=False):
        start, length = found[id(t)]
        out |= t.symbol[start[spots]].astype(np.uint32) << np.uint32(shift)
        spots = spots + length[spots]
    r.at = at + 8 * first
    return out


def _read_image(r: _Reader, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = r.take(4) if r.take(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    groups, choice, bits, across = 1, None, 0, 0
    if main and r.take(1):
        bits = r.take(3) + 2
        across = (width + (1 << bits) - 1) >> bits
        entropy = _read_image(r, across, (height + (1 << bits) - 1) >> bits, False)
        choice = (entropy >> 8 & 0xFFFF).astype(np.int64)
        groups = int(choice.max()) + 1
        choice = choice.tolist()
    cache_size = 1 << cache_bits if cache_bits else 0
    codes = []
    known: list[tuple[int, int, int, _Table]] = []
    for _ in range(groups):
        group = []
        for size in (256 + 24 + cache_size, 256, 256, 256, 40):
            # The bits of a code description that came before mean the same table again.
            ahead = int.from_bytes(r.data[r.at >> 3 : (r.at >> 3) + 2 * size + 8], "little") >> (r.at & 7)
            for bits_, n_bits, fits, table in known:
                if fits <= size and ahead & ((1 << n_bits) - 1) == bits_:
                    r.at += n_bits
                    break
            else:
                begin = r.at
                lengths, stated = _read_lengths(r, size)
                table = _Table(lengths)
                n_bits = r.at - begin
                if stated:
                    known.append((ahead & ((1 << n_bits) - 1), n_bits, int(np.flatnonzero(lengths)[-1]) + 1, table))
            group.append(table)
        codes.append(group)
    n = width * height
    if groups == 1 and (plain := _literals(r, codes[0], n)) is not None:
        return plain
    out = [0] * n
    cache = [0] * cache_size
    shift = 32 - cache_bits
    i = 0
    while i < n:
        group = codes[choice[(i // width >> bits) * across + (i % width >> bits)]] if choice else codes[0]
        s = r.symbol(group[0])
        if s < 256:
            red, blue, alpha = (r.symbol(t) for t in group[1:4])
            fresh = [alpha << 24 | red << 16 | s << 8 | blue]
        elif s < 280:
            length = _unprefix(s - 256, r)
            back = _distance(_unprefix(r.symbol(group[4]), r), width)
            if back > i or i + length > n:
                raise ValueError("a back-reference leaves the image")
            for k in range(i, i + length):
                out[k] = out[k - back]
            fresh = out[i : i + length]
        else:
            fresh = [cache[s - 280]]
        out[i : i + len(fresh)] = fresh
        i += len(fresh)
        if cache_size:
            for p in fresh:
                cache[(CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> shift] = p
    if r.at > 8 * len(r.raw):
        raise ValueError("the data end too early")
    return np.array(out, np.uint32)


def decode(data: bytes) -> np.ndarray:
    """(height, width) ARGB pixels of one lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    size = int.from_bytes(data[16:20], "little")
    r = _Reader(bytes(data[20 : 20 + size]))
    if r.take(8) != 0x2F:
        raise ValueError("wrong signature")
    full, height = r.take(14) + 1, r.take(14) + 1
    r.take(1)
    if r.take(3):
        raise ValueError("unknown version")
    width, undo, seen = full, [], set()
    while r.take(1):
        kind = r.take(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.take(3) + 2
            sub = _read_image(r, (width + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits, False)
            undo.append((kind, width, bits, sub))
        elif kind == SUBTRACT_GREEN:
            undo.append((kind, width, 0, None))
        else:
            steps = _read_image(r, r.take(8) + 1, 1, False)
            palette = np.zeros(len(steps), np.uint32)
            for s in (0, 8, 16, 24):
                palette |= (np.cumsum(steps >> np.uint32(s) & np.uint32(0xFF)).astype(np.uint32) & np.uint32(0xFF)) << np.uint32(s)
            undo.append((kind, width, 0, palette))
            bits = _packing(len(palette))
            width = (width + (1 << bits) - 1) >> bits
    pixels = _read_image(r, width, height, True)
    for kind, w, bits, sub in reversed(undo):
        if kind == PREDICTOR:
            pixels = _guessed(pixels, w, height, bits, sub, False)
        elif kind == CROSS_COLOUR:
            pixels = _crossed(pixels, w, height, bits, sub.astype(np.int64), 1)
        elif kind == SUBTRACT_GREEN:
            pixels = _green(pixels, 1)
        else:
            pixels = _indexed(pixels, w, height, sub)
    return pixels.reshape(height, full)


# ---- encoder ----


@dataclass
class Tools:
    """What the encoder uses besides literals."""

    transforms: tuple[int, ...] = ()
    modes: tuple[int, ...] = (11,)
    elements: tuple[int, ...] = (0xFF102030,)
    block_bits: int = 2
    cache_bits: int = 0
    #: (pixel, length, distance code) of back-references, in order and apart
    copies: list[tuple[int, int, int]] = field(default_factory=list)
    group_bits: int = 0


def _write_lengths(w: _Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        w.put(1, 1)
        w.put(int(len(used) == 2), 1)
        w.put(1, 1)
        for s in used if len(used) else [0]:
            w.put(int(s), 8)
        return
    plain, symbols, extras, sizes = lengths[: used[-1] + 1].tolist(), [], [], []
    i, n = 0, len(plain)
    while i < n:
        j = i
        while j < n and plain[j] == plain[i]:
            j += 1
        run = j - i
        if plain[i]:
            symbols.append(plain[i])
            extras.append(0)
            sizes.append(0)
            run -= 1
        while run >= 3:
            k = min(run, 6 if plain[i] else 138)
            s = 16 if plain[i] else 17 if k < 11 else 18
            symbols.append(s)
            extras.append(k - (11 if s == 18 else 3))
            sizes.append({16: 2, 17: 3, 18: 7}[s])
            run -= k
        symbols += [plain[i]] * run
        extras += [0] * run
        sizes += [0] * run
        i = j
    own = code_lengths(np.bincount(symbols, minlength=19), 7)
    last = max(k for k, s in enumerate(LENGTH_ORDER) if own[s]) + 1
    w.put(0, 1)
    w.put(max(last, 4) - 4, 4)
    for s in LENGTH_ORDER[: max(last, 4)]:
        w.put(int(own[s]), 3)
    # The number of codes is stated, so zeros at the end are left out, whatever the alphabet's size.
    bits = max(2, (len(symbols) - 2).bit_length() + 1 & ~1)
    w.put(1, 1)
    w.put((bits - 2) // 2, 3)
    w.put(len(symbols) - 2, bits)
    codes = canonical(own)
    bits = own if np.count_nonzero(own) > 1 else np.zeros_like(own)
    s = np.array(symbols)
    w.many(np.stack([codes[s], np.array(extras)], axis=1).ravel(), np.stack([bits[s], np.array(sizes)], axis=1).ravel())


#: Distances (pixels) at which the encoder looks for repeated runs, and the shortest run that it refers back to.
REACH, LEAST_RUN = (1, 2, 3, 4, 5, 6, 7, 8, 16, 32, 48, 64), 4
#: Side of the blocks (a power of two) that share a predictor.
BLOCK_BITS = 9
#: Largest image that is written with a colour cache.
CACHED = 96


def _repeats(pixels: np.ndarray) -> list[tuple[int, int, int]]:
    """Back-references at the distance that covers most pixels, if they cover half of the image or more."""
    n, best = len(pixels), (0, 0)
    for d in REACH:
        if d < n:
            best = max(best, (int((pixels[d:] == pixels[:-d]).sum()), -d))
    d = -best[1]
    if best[0] * 2 < n:
        return []
    same = np.concatenate([np.zeros(d, bool), pixels[d:] == pixels[:-d], [False]])
    edge = np.flatnonzero(np.diff(same.astype(np.int8), prepend=0))
    out = []
    for start, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        for at in range(start, end, 4096):
            if min(end, at + 4096) - at >= LEAST_RUN:
                out.append((at, min(end, at + 4096) - at, d + 120))
    return out if sum(length for _, length, _ in out) * 2 >= n else []


def _size(channels: np.ndarray) -> float:
    """Bits of an image (bytes of its pixels) as literals under one code, by their entropy."""
    counts = np.bincount(channels.ravel(), minlength=256)
    counts = counts[counts > 0]
    return float((counts * np.log2(channels.size / counts)).sum())


def tools_for(image: np.ndarray) -> Tools:
    """Tools by the image's content alone: back-references if they cover half of it; else a palette for few colours; else a
    colour cache for small images with repeated pixels; else whichever of no transform, less green, and less the pixel
    above leaves bytes of the least entropy."""
    height, width = image.shape
    pixels = image.astype(np.uint32).ravel()
    if copies := _repeats(pixels):
        return Tools(copies=copies, cache_bits=4)
    colours = len(np.unique(pixels)) if len(pixels) <= 1 << 12 else len(pixels)
    if colours <= 256 and 2 * colours <= len(pixels):
        return Tools((COLOUR_INDEXING,))
    if len(pixels) <= CACHED and 10 * colours <= 9 * len(pixels):
        return Tools(cache_bits=6)
    blocks = -(-height // (1 << BLOCK_BITS)) * -(-width // (1 << BLOCK_BITS))
    own = np.ascontiguousarray(pixels, "<u4").view(np.uint8).reshape(height, width * 4)
    less_green = own.copy()
    less_green[:, ::4] -= own[:, 1::4]
    less_green[:, 2::4] -= own[:, 1::4]
    sizes = {(): _size(own), (SUBTRACT_GREEN,): _size(less_green) + 64, (PREDICTOR,): _size(np.ascontiguousarray(_from_top(pixels.reshape(height, width), True), "<u4").view(np.uint8)) + 64 + blocks}
    return Tools(min(sizes, key=sizes.get), modes=(TOP,), block_bits=BLOCK_BITS)


#: Longest code that the encoder uses for literals; short codes keep the tables of lookups small.
LITERAL_BITS = 11


def _write_literals(w: _Writer, pixels: np.ndarray, main: bool = False) -> None:
    """An image of literals under one code shared by the four channels, without cache, and without groups if main."""
    w.put(0, 1)
    if main:
        w.put(0, 1)
    channels = np.stack([pixels >> np.uint32(s) & np.uint32(m) for s, m in _CHANNELS], axis=1).astype(np.int64)
    lengths = code_lengths(np.bincount(channels.ravel(), minlength=256), LITERAL_BITS)
    one = _Writer()
    _write_lengths(one, lengths)
    for _ in _CHANNELS:
        w.append(one)
    _write_lengths(w, np.zeros(40, np.int64))
    bits = lengths if np.count_nonzero(lengths) > 1 else np.zeros_like(lengths)
    w.many(canonical(lengths)[channels].ravel(), bits[channels].ravel())


def _write_mixed(w: _Writer, pixels: np.ndarray, width: int, tools: Tools) -> None:
    """The main image with back-references, colour cache and code groups."""
    n, cache_size = len(pixels), 1 << tools.cache_bits if tools.cache_bits else 0
    plain, cache, i = pixels.tolist(), {}, 0
    starts = {at: (length, code) for at, length, code in tools.copies}
    steps: list[tuple[int, list[tuple[int, int, int, int]]]] = []  # pixel, [(code, symbol, extra, bits)]
    while i < n:
        taken = 1
        if i in starts:
            taken, code = starts[i]
            length, distance = _prefix(taken), _prefix(code)
            steps.append((i, [(0, 256 + length[0], *length[1:]), (4, distance[0], *distance[1:])]))
        elif cache_size and cache.get(key := (CACHE_MULTIPLIER * plain[i] & 0xFFFFFFFF) >> (32 - tools.cache_bits)) == plain[i]:
            steps.append((i, [(0, 280 + key, 0, 0)]))
        else:
            steps.append((i, [(k, plain[i] >> s & m, 0, 0) for k, (s, m) in enumerate(_CHANNELS)]))
        for p in plain[i : i + taken]:
            if cache_size:
                cache[(CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> (32 - tools.cache_bits)] = p
        i += taken
    w.put(int(bool(cache_size)), 1)
    if cache_size:
        w.put(tools.cache_bits, 4)
    w.put(int(bool(tools.group_bits)), 1)
    groups, bits = 1, tools.group_bits
    if bits:
        across, down = (width + (1 << bits) - 1) >> bits, (n // width + (1 << bits) - 1) >> bits
        groups = min(2, across * down)
        w.put(bits - 2, 3)
        _write_literals(w, ((np.arange(across * down) % groups).astype(np.uint32) << np.uint32(8)))
    group = lambda i: ((i // width >> bits) * across + (i % width >> bits)) % groups if bits else 0
    sizes = (280 + cache_size, 256, 256, 256, 40)
    counts = [[np.zeros(s, np.int64) for s in sizes] for _ in range(groups)]
    for i, symbols in steps:
        for k, s, _, _ in symbols:
            counts[group(i)][k][s] += 1
    coded = []
    for own in counts:
        row = []
        for c in own:
            lengths = code_lengths(c) if c.any() else c
            _write_lengths(w, lengths)
            row.append((canonical(lengths), lengths if np.count_nonzero(lengths) > 1 else np.zeros_like(lengths)))
        coded.append(row)
    for i, symbols in steps:
        for k, s, extra, extra_bits in symbols:
            codes, lengths = coded[group(i)][k]
            w.put(int(codes[s]), int(lengths[s]))
            if extra_bits:
                w.put(extra, extra_bits)


def encode(image: np.ndarray, tools: Tools | None = None) -> bytes:
    """A lossless WebP file of (height, width) ARGB pixels."""
    height, width = image.shape
    pixels, tools = image.astype(np.uint32).ravel(), tools or Tools()
    w = _Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    blocks = lambda w_: ((w_ + (1 << tools.block_bits) - 1) >> tools.block_bits) * ((height + (1 << tools.block_bits) - 1) >> tools.block_bits)
    for kind in tools.transforms:
        w.put(1, 1)
        w.put(kind, 2)
        if kind == SUBTRACT_GREEN:
            pixels = _green(pixels, -1)
        elif kind == COLOUR_INDEXING:
            palette, index = np.unique(pixels, return_inverse=True)
            w.put(len(palette) - 1, 8)
            steps = palette.copy()
            steps[1:] = [_subtract(int(a), int(b)) for a, b in zip(palette[1:], palette[:-1], strict=True)]
            _write_literals(w, steps)
            bits = _packing(len(palette))
            narrow = (width + (1 << bits) - 1) >> bits
            packed = np.zeros(narrow * height, np.uint32)
            y, x = np.divmod(np.arange(width * height), width)
            np.bitwise_or.at(packed, y * narrow + (x >> bits), (index.ravel() << (x & ((1 << bits) - 1)) * (8 >> bits)).astype(np.uint32) << np.uint32(8))
            pixels, width = packed | np.uint32(0xFF000000), narrow
        else:
            w.put(tools.block_bits - 2, 3)
            values = tools.modes if kind == PREDICTOR else tools.elements
            sub = np.resize(np.array(values, np.uint32), blocks(width))
            _write_literals(w, sub << np.uint32(8) if kind == PREDICTOR else sub)
            if kind == PREDICTOR:
                pixels = _guessed(pixels, width, height, tools.block_bits, sub << np.uint32(8), True)
            else:
                pixels = _crossed(pixels, width, height, tools.block_bits, sub.astype(np.int64), -1)
    w.put(0, 1)
    if tools.cache_bits or tools.copies or tools.group_bits:
        _write_mixed(w, pixels, width, tools)
    else:
        _write_literals(w, pixels, True)
    body = w.done()
    body += b"\0" * (len(body) & 1)
    chunk = b"VP8L" + (len(body)).to_bytes(4, "little") + body
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk
