"""Lossless WebP (VP8L): a full decoder and two writers, in plain numpy.

``decode`` reads every feature of the format: simple and normal prefix codes, meta prefix
images, back-references with the two-dimensional distance codes, the colour cache, and the
predictor, cross-colour, subtract-green and palette transforms.  Images without cache and meta
codes whose red, blue and alpha are constant are read by a shorter loop over green codes.

``encode_samples`` writes 8-bit samples as grey pixels: prefix codes, back-references, and a
palette (few colours) or cross-colour transform, with a predictor where that takes fewer bits.
``encode`` writes any image with the transforms asked for, at scalar speed.
"""

from __future__ import annotations

import heapq
import struct
from functools import lru_cache

import numpy as np

# Fixed values of the format: the order in which code length codes are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
# Fixed values of the format: the offsets (x, y) of the 120 short distance codes.
SHORT_DISTANCES = (
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
MAX_SIDE = 16384
#: Bits of the table that gives several literals at once, and pixels from which it is made.
RUN_BITS, RUN_PIXELS = 14, 256
CACHE_MULTIPLIER = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)


class BitReader:
    """Least significant bit first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.end = data, at * 8, len(data) * 8

    def peek(self, n: int) -> int:
        first = self.at >> 3
        return (int.from_bytes(self.data[first : first + 8], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        if self.at + n > self.end:
            raise ValueError("truncated image data")
        value = self.peek(n)
        self.at += n
        return value


    def take(self, n: int) -> np.ndarray:
        """The next ``n`` bits as an array."""
        if self.at + n > self.end:
            raise ValueError("truncated image data")
        first, skip = self.at >> 3, self.at & 7
        raw = np.frombuffer(self.data, np.uint8, count=(skip + n + 7) // 8, offset=first)
        self.at += n
        return np.unpackbits(raw, bitorder="little")[skip : skip + n]


class BitWriter:
    def __init__(self):
        self.value, self.bits, self.out = 0, 0, bytearray()

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.bits
        self.bits += n
        while self.bits >= 8:
            self.out.append(self.value & 255)
            self.value >>= 8
            self.bits -= 8

    def done(self) -> bytes:
        return bytes(self.out) + (bytes([self.value & 255]) if self.bits else b"")


class PrefixCode:
    """Canonical code given the length of each symbol; a lone symbol takes no bits.

    The table is built when the first symbol is read or written one by one.
    """

    def __init__(self, lengths):
        self.lengths = np.asarray(lengths, np.uint8)
        self.used = np.flatnonzero(self.lengths)
        self.only = int(self.used[0]) if len(self.used) == 1 else None if len(self.used) else 0
        self.width, self.table, self.codes, self._lists, self._runs, self._arrays = 0, None, {}, None, None, None

    def build(self) -> None:
        lengths = self.lengths.tolist()
        self.width = max(lengths)
        table = [None] * (1 << self.width)
        code, last = 0, 0
        for n, s in sorted((lengths[s], s) for s in self.used.tolist()):
            code <<= n - last
            last = n
            back = int(f"{code:0{n}b}"[::-1], 2)
            self.codes[s] = (back, n)
            table[back :: 1 << n] = [(s, n)] * len(range(back, len(table), 1 << n))
            code += 1
        if code != 1 << last:
            raise ValueError("prefix code is not complete")
        self.table = table

    def read(self, bits: BitReader) -> int:
        if self.only is not None:
            return self.only
        if self.table is None:
            self.build()
        symbol, n = self.table[bits.peek(self.width)]
        bits.at += n
        return symbol

    def write(self, bits: BitWriter, symbol: int) -> None:
        if self.only is None:
            if self.table is None:
                self.build()
            bits.write(*self.codes[symbol])

    def lists(self) -> tuple[int, list[int], list[int]]:
        """(mask, symbols, sizes) by the next bits of the stream."""
        if self._lists is None:
            if self.only is not None:
                self._lists = 0, [self.only], [0]
            else:
                if self.table is None:
                    self.build()
                self._lists = len(self.table) - 1, [s for s, _ in self.table], [n for _, n in self.table]
        return self._lists

    def runs(self) -> tuple[list[bytes], list[int]]:
        """By the next RUN_BITS bits: up to three literals whose codes end in them, and the bits they take."""
        if self._runs is None:
            mask, symbols, sizes = self.lists()
            symbols, sizes = np.array(symbols), np.array(sizes)
            window, literals = np.arange(1 << RUN_BITS), np.zeros((1 << RUN_BITS, 3), np.uint8)
            used, count, going = np.zeros(1 << RUN_BITS, np.int64), np.zeros(1 << RUN_BITS, np.int64), np.ones(1 << RUN_BITS, bool)
            for k in range(3):
                at = (window >> used) & mask
                going &= (symbols[at] < 256) & (used + sizes[at] <= RUN_BITS)
                literals[going, k] = symbols[at[going]]
                used += sizes[at] * going
                count += going
            blob = literals.tobytes()
            self._runs = [blob[3 * k : 3 * k + c] for k, c in enumerate(count.tolist())], used.tolist()
        return self._runs

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """(code, size) of each symbol."""
        if self._arrays is not None:
            return self._arrays
        code, size = np.zeros(len(self.lengths), np.uint64), np.zeros(len(self.lengths), np.int64)
        if self.only is None:
            if self.table is None:
                self.build()
            for s, (c, n) in self.codes.items():
                code[s], size[s] = c, n
        self._arrays = code, size
        return code, size


#: Codes read lately by (alphabet, bits, their value); a code's bits say where they end, so equal
#: first bits are an equal code.  Images of one writer share many.
_codes: dict[tuple[int, int, int], PrefixCode] = {}
_sizes: dict[int, set[int]] = {}


def read_code(bits: BitReader, size: int) -> PrefixCode:
    at = bits.at
    first, skip = at >> 3, at & 7
    for n in _sizes.get(size, ()):
        value = int.from_bytes(bits.data[first : (at + n + 7) >> 3], "little") >> skip & ((1 << n) - 1)
        if at + n <= bits.end and (code := _codes.get((size, n, value))):
            bits.at += n
            return code
    code = parse_code(bits, size)
    n = bits.at - at
    value = int.from_bytes(bits.data[first : (bits.at + 7) >> 3], "little") >> skip & ((1 << n) - 1)
    if len(_codes) >= 64:
        _codes.clear()
        _sizes.clear()
    _codes[(size, n, value)] = code
    _sizes.setdefault(size, set()).add(n)
    return code


def parse_code(bits: BitReader, size: int) -> PrefixCode:
    lengths = [0] * size
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else [])
        for s in symbols:
            lengths[s] = 1
        return PrefixCode(lengths)
    kinds = [0] * 19
    for i in range(4 + bits.read(4)):
        kinds[LENGTH_ORDER[i]] = bits.read(3)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    code, at, last = PrefixCode(kinds), 0, 8
    if code.used.max(initial=0) < 16 and len(code.used) in (1, 2):  # one bit, or none, for each length
        n, each = min(size, left), len(code.used) - 1
        if each and not (code.lengths[code.used] == 1).all():
            raise ValueError("prefix code is not complete")
        full = np.zeros(size, np.uint8)
        full[:n] = code.used[bits.take(n * each)] if each else code.used[0]
        return PrefixCode(full)
    while at < size and left:
        left -= 1
        kind = code.read(bits)
        if kind < 16:
            lengths[at] = kind
            last, at = kind or last, at + 1
            continue
        value, times = (last, 3 + bits.read(2)) if kind == 16 else (0, 3 + bits.read(3) if kind == 17 else 11 + bits.read(7))
        if at + times > size:
            raise ValueError("code lengths overrun the alphabet")
        lengths[at : at + times] = [value] * times
        at += times
    return PrefixCode(lengths)


def spread(code: int, bits: BitReader) -> int:
    """Value of a length or distance code."""
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + bits.read(extra) + 1


def unspread(value: int) -> tuple[int, int, int]:
    """(code, extra bits, their value)"""
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    second = (v >> (top - 1)) & 1
    return 2 * top + second, top - 1, v & ((1 << (top - 1)) - 1)


def far_of(code: int, width: int) -> int:
    """Distance in pixels of a distance value."""
    if code > 120:
        return code - 120
    x, y = SHORT_DISTANCES[code - 1]
    return max(1, x + y * width)


def read_green(bits: BitReader, group, width: int, n: int, top: bool) -> np.ndarray:
    """Pixels whose red, blue and alpha are constant."""
    padded = np.zeros(len(bits.data) + 4, np.uint32)
    padded[:-4] = np.frombuffer(bits.data, np.uint8)
    words = (padded[:-3] | padded[1:-2] << np.uint32(8) | padded[2:-1] << np.uint32(16) | padded[3:] << np.uint32(24)).tolist()
    mask, symbols, sizes = group[0].lists()
    d_mask, d_symbols, d_sizes = group[4].lists()
    out, p, end = bytearray(), bits.at, bits.end
    some, taken, stop, run_mask = [], [], -1, (1 << RUN_BITS) - 1
    if top and n >= RUN_PIXELS:
        (some, taken), stop = group[0].runs(), end - RUN_BITS
    while len(out) < n and p <= end:
        # Nothing follows the top image, so what runs past its last pixel does no harm.
        while p <= stop and (run := some[code := words[p >> 3] >> (p & 7) & run_mask]):
            out += run
            p += taken[code]
        if len(out) >= n:
            break
        code = words[p >> 3] >> (p & 7) & mask
        p += sizes[code]
        symbol = symbols[code]
        if symbol < 256:
            out.append(symbol)
            continue
        length = symbol - 255
        if symbol >= 260:
            extra = (symbol - 258) >> 1
            length = ((2 + (symbol & 1)) << extra) + (words[p >> 3] >> (p & 7) & ((1 << extra) - 1)) + 1
            p += extra
        if p > end:
            break
        code = words[p >> 3] >> (p & 7) & d_mask
        p += d_sizes[code]
        far = d_symbols[code] + 1
        if far > 4:
            extra = (far - 3) >> 1
            far = ((3 - (far & 1)) << extra) + (words[min(p >> 3, len(words) - 1)] >> (p & 7) & ((1 << extra) - 1)) + 1
            p += extra
        far = far_of(far, width)
        at = len(out)
        if far > at or at + length > n:
            raise ValueError("back-reference outside the image")
        if far >= length:
            out += out[at - far : at - far + length]
        else:
            out += (out[at - far :] * (length // far + 1))[:length]
    if len(out) < n or p > end:
        raise ValueError("truncated image data")
    bits.at = p
    del out[n:]
    rest = group[3].only << 24 | group[1].only << 16 | group[2].only
    return np.frombuffer(out, np.uint8).astype(np.uint32) << np.uint32(8) | np.uint32(rest)


def read_pixels(bits: BitReader, width: int, height: int, top: bool) -> np.ndarray:
    """One entropy-coded image as ARGB words."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    meta, meta_bits, groups = None, 0, 1
    if top and bits.read(1):
        meta_bits = bits.read(3) + 2
        across = (width + (1 << meta_bits) - 1) >> meta_bits
        meta = (read_pixels(bits, across, (height + (1 << meta_bits) - 1) >> meta_bits, False) >> 8) & 0xFFFF
        groups = int(meta.max()) + 1
    cached = 1 << cache_bits if cache_bits else 0
    codes = [[read_code(bits, n) for n in (280 + cached, 256, 256, 256, 40)] for _ in range(groups)]
    n = width * height
    if meta is None and not cached and all(c.only is not None for c in codes[0][1:4]):
        return read_green(bits, codes[0], width, n, top)
    out, cache, at, seen = [0] * n, [0] * cached, 0, 0
    group = codes[0]
    while at < n:
        if meta is not None:
            group = codes[meta[((at // width) >> meta_bits) * across + ((at % width) >> meta_bits)]]
        symbol = group[0].read(bits)
        if symbol < 256:
            red = group[1].read(bits)
            blue = group[2].read(bits)
            out[at] = group[3].read(bits) << 24 | red << 16 | symbol << 8 | blue
            at += 1
        elif symbol < 280:
            length = spread(symbol - 256, bits)
            far = far_of(spread(group[4].read(bits), bits), width)
            if far > at or at + length > n:
                raise ValueError("back-reference outside the image")
            for k in range(at, at + length):
                out[k] = out[k - far]
            at += length
        else:
            while seen < at:
                cache[(CACHE_MULTIPLIER * out[seen] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[seen]
                seen += 1
            out[at] = cache[symbol - 280]
            at += 1
        if bits.at > bits.end:
            raise ValueError("truncated image data")
    return np.array(out, np.uint32)


def channels(argb: int) -> tuple[int, int, int, int]:
    return argb >> 24, argb >> 16 & 255, argb >> 8 & 255, argb & 255


def average(a: int, b: int) -> int:
    return sum(((x + y) // 2) << s for x, y, s in zip(channels(a), channels(b), (24, 16, 8, 0)))


def clamp(v: int) -> int:
    return 0 if v < 0 else 255 if v > 255 else v


def towards(left: int, above: int, corner: int) -> int:
    """The neighbour nearer to left + above - corner."""
    pairs = zip(channels(left), channels(above), channels(corner))
    to_left = to_above = 0
    for x, y, c in pairs:
        guess = x + y - c
        to_left += abs(guess - x)
        to_above += abs(guess - y)
    return left if to_left < to_above else above


def predict(mode: int, left: int, above: int, corner: int, next_above: int) -> int:
    if mode in (0, 14, 15):
        return 0xFF000000
    if mode <= 4:
        return (left, above, next_above, corner)[mode - 1]
    if mode == 5:
        return average(average(left, next_above), above)
    if mode <= 9:
        return average(*((left, corner), (left, above), (corner, above), (above, next_above))[mode - 6])
    if mode == 10:
        return average(average(left, corner), average(above, next_above))
    if mode == 11:
        return towards(left, above, corner)
    if mode == 12:
        return sum(clamp(x + y - c) << s for x, y, c, s in zip(channels(left), channels(above), channels(corner), (24, 16, 8, 0)))
    mean = average(left, above)
    full = lambda m, c: clamp(m + int((m - c) / 2))
    return sum(full(m, c) << s for m, c, s in zip(channels(mean), channels(corner), (24, 16, 8, 0)))


def add(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def subtract(a: int, b: int) -> int:
    return add(a, sum((-v & 255) << s for v, s in zip(channels(b), (24, 16, 8, 0))))


def predicted(pixels: list[int], at: int, width: int, modes, size_bits: int, across: int) -> int:
    """The prediction for pixel ``at`` from the pixels before it."""
    x, y = at % width, at // width
    if y == 0:
        return pixels[at - 1] if x else 0xFF000000
    if x == 0:
        return pixels[at - width]
    mode = int(modes[(y >> size_bits) * across + (x >> size_bits)]) >> 8 & 15
    return predict(mode, pixels[at - 1], pixels[at - width], pixels[at - width - 1], pixels[at - width + 1])


def undo_predictor(argb, width, height, modes, size_bits) -> np.ndarray:
    kinds = np.unique(modes >> 8 & 15)
    if len(kinds) == 1 and kinds[0] in (1, 2):  # all from the left, or all from above: running sums
        by = argb.astype("<u4").view(np.uint8).reshape(height, width, 4)
        by[0, 0, 3] = (int(by[0, 0, 3]) + 255) & 255
        first, then = (0, 1) if kinds[0] == 1 else (1, 0)
        if first == 0:
            by[:, 0] = np.cumsum(by[:, 0], axis=0, dtype=np.uint8)
        else:
            by[0] = np.cumsum(by[0], axis=0, dtype=np.uint8)
        return np.cumsum(by, axis=then, dtype=np.uint8).view("<u4").reshape(-1)
    out, across = argb.tolist(), (width + (1 << size_bits) - 1) >> size_bits
    for at in range(width * height):
        out[at] = add(out[at], predicted(out, at, width, modes, size_bits, across))
    return np.array(out, np.uint32)


def colour_shift(argb, width, height, blocks, size_bits, sign: int) -> np.ndarray:
    """Apply (sign 1) or undo (-1 of the writer's view) the cross-colour transform."""
    across = (width + (1 << size_bits) - 1) >> size_bits
    if (blocks == blocks[0]).all():
        b = blocks[:1]
    else:
        y, x = np.divmod(np.arange(width * height), width)
        b = blocks[(y >> size_bits) * across + (x >> size_bits)]
    signed = lambda v: (v & 255).astype(np.uint8).view(np.int8).astype(np.int32)
    green, red, blue = (signed(argb >> s) for s in (8, 16, 0))
    to_red, to_blue, red_to_blue = signed(b), signed(b >> 8), signed(b >> 16)
    new_red = red + sign * (to_red * green >> 5)
    source = signed(new_red.astype(np.uint32)) if sign > 0 else red
    new_blue = blue + sign * (to_blue * green >> 5) + sign * (red_to_blue * source >> 5)
    return (argb & 0xFF00FF00) | ((new_red & 255).astype(np.uint32) << 16) | (new_blue & 255).astype(np.uint32)


def undo_palette(argb, width, full_width, height, table, pack) -> np.ndarray:
    index = ((argb >> 8) & 255).reshape(height, width)
    if pack:
        each, depth = 1 << pack, 8 >> pack
        index = (index[:, :, None] >> (np.arange(each) * depth)) & ((1 << depth) - 1)
        index = index.reshape(height, -1)[:, :full_width]
    full = np.zeros(256, np.uint32)
    full[: len(table)] = table
    return full[index.reshape(-1)]


def palette_pack(size: int) -> int:
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def running_sum(table: np.ndarray) -> np.ndarray:
    by = table.astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.cumsum(by, axis=0, dtype=np.uint8).view("<u4").reshape(-1)


def decode(data: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, ARGB words) of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    size = struct.unpack("<I", data[16:20])[0]
    bits = BitReader(data[: 20 + size], 21)
    full_width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    width, undo, seen = full_width, [], set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform is given twice")
        seen.add(kind)
        if kind == SUBTRACT_GREEN:
            undo.append((kind, width, None, 0))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            table = running_sum(read_pixels(bits, n, 1, False))
            undo.append((kind, width, table, palette_pack(n)))
            width = (width + (1 << palette_pack(n)) - 1) >> palette_pack(n)
        else:
            b = bits.read(3) + 2
            blocks = read_pixels(bits, (width + (1 << b) - 1) >> b, (height + (1 << b) - 1) >> b, False)
            undo.append((kind, width, blocks, b))
    argb = read_pixels(bits, width, height, True)
    for kind, before, what, b in reversed(undo):
        if kind == PREDICTOR:
            argb = undo_predictor(argb, before, height, what, b)
        elif kind == CROSS_COLOUR:
            argb = colour_shift(argb, before, height, what, b, 1)
        elif kind == SUBTRACT_GREEN:
            green = (argb >> 8) & 255
            argb = (argb & 0xFF00FF00) | ((((argb >> 16) & 255) + green & 255) << 16) | ((argb & 255) + green & 255)
        else:
            argb = undo_palette(argb, width, before, height, what, b)
            width = before
    return full_width, height, argb


def container(stream: bytes) -> bytes:
    body = b"VP8L" + struct.pack("<I", len(stream)) + stream + b"\0" * (len(stream) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body


def begin(width: int, height: int) -> BitWriter:
    bits = BitWriter()
    bits.write(0x2F, 8)
    bits.write(width - 1, 14)
    bits.write(height - 1, 14)
    bits.write(1, 1)
    bits.write(0, 3)
    return bits


def code_lengths(counts) -> list[int]:
    """Code lengths of at most 15 bits for the symbol counts."""
    counts = np.asarray(counts, np.int64)
    floor = 0
    while True:
        heap = [(max(int(c), floor), s, None, None) for s, c in enumerate(counts) if c]
        lengths = [0] * len(counts)
        if len(heap) == 1:
            lengths[heap[0][1]] = 1
        heapq.heapify(heap)
        tick = len(counts)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a[0] + b[0], tick, a, b))
            tick += 1
        stack = [(heap[0], 0)] if heap and heap[0][2] else []
        while stack:
            (_, s, a, b), depth = stack.pop()
            if a is None:
                lengths[s] = depth
            else:
                stack += [(a, depth + 1), (b, depth + 1)]
        if max(lengths, default=0) <= 15:
            return lengths
        floor = max(1, 2 * floor, int(counts.sum()) >> 14)


def write_code(bits: BitWriter, lengths) -> PrefixCode:
    """Store a code; returns it."""
    used = [s for s, n in enumerate(lengths) if n]
    code = PrefixCode(lengths)
    if len(used) <= 1 and (not used or used[0] < 256):
        bits.write(1, 1)
        bits.write(0, 1)
        bits.write(1, 1)
        bits.write(used[0] if used else 0, 8)
        return code
    bits.write(0, 1)
    last = used[-1] + 1
    kinds = [0] * 19
    present = sorted(set(lengths[:last]))
    depth = 0 if len(present) == 1 else max(1, (len(present) - 1).bit_length())
    # Kraft-complete: the first symbols get the shorter codes.
    short = (1 << depth) - len(present)
    for k, value in enumerate(present):
        kinds[value] = max(1, depth - (k < short))
    n = 4
    for k, kind in enumerate(LENGTH_ORDER):
        if kinds[kind]:
            n = max(n, k + 1)
    bits.write(n - 4, 4)
    for kind in LENGTH_ORDER[:n]:
        bits.write(kinds[kind], 3)
    if last < len(lengths) and last >= 2:
        wide = max(1, ((last - 2).bit_length() + 1) // 2)
        bits.write(1, 1)
        bits.write(wide - 1, 3)
        bits.write(last - 2, 2 * wide)
    else:
        bits.write(0, 1)
        last = len(lengths)
    code_of_lengths = PrefixCode(kinds)
    for s in range(last):
        code_of_lengths.write(bits, lengths[s])
    return code


def shape(n: int) -> tuple[int, int]:
    """Width and height for ``n`` pixels, rows of 16 pixels where that fits."""
    width = 16
    if n > MAX_SIDE * MAX_SIDE:
        raise ValueError(f"{n} pixels are more than an image of {MAX_SIDE} by {MAX_SIDE} holds")
    while -(-n // width) > MAX_SIDE:
        width *= 2
    return width, max(1, -(-n // width))


#: A match has so many bytes at least, and lies so far back at most; samples from which an image
#: gets codes of its own.
MATCH, WINDOW, OWN_CODES = 8, (1 << 20) - 120, 32768


def matches(green: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, distance) of repeats, taken greedily from the front, each from the last place with equal bytes."""
    n = len(green) - MATCH + 1
    if n < 2:
        return []
    keys = np.zeros(n, np.uint64)
    for k in range(MATCH):
        keys |= green[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    if n <= 1 << 20:  # a digest of the bytes and the place in one number: sorting these is stable
        low = np.uint64((1 << 20) - 1)
        mixed = keys * np.uint64(0x9E3779B97F4A7C15) & ~low | np.arange(n, dtype=np.uint64)
        order = (np.sort(mixed) & low).astype(np.int64)
    else:
        order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    back = np.zeros(n + 1, np.int64)
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    back[back > WINDOW] = 0
    ends = np.flatnonzero(back[1:] != back[:-1])  # the last start of a run at one distance
    found = np.flatnonzero(back)
    if not len(found):
        return []
    lengths = ends[np.searchsorted(ends, found)] - found + MATCH
    out, at = [], 0
    for start, length, far in zip(found.tolist(), lengths.tolist(), back[found].tolist()):
        if start < at:
            if start + length < at + MATCH:
                continue
            length, start = length - (at - start), at  # the run goes on past what is taken
        if length <= 4096:
            out.append((start, length, far))
        else:
            out += [(start + k, min(4096, length - k), far) for k in range(0, length, 4096)]
        at = start + length
    return out


def usual_codes() -> tuple[list[int], list[int]]:
    """Code lengths of green and of distances for short texts, from a rule on counts."""
    counts = np.ones(280, np.int64)
    counts[0x80:0xC0], counts[0xC2:0xF0] = 6, 3
    counts[ord("A") : ord("Z") + 1], counts[ord("0") : ord("9") + 1] = 8, 20
    for k, letter in enumerate(" etaoinshrdlcumwfgypbvkxjqz"):
        counts[ord(letter)] = max(8, int(1800 * 0.87**k))
    for letter, n in zip("\n.,\0", (60, 120, 80, 40)):
        counts[ord(letter)] = n
    counts[260:272] = 50
    far = np.ones(40, np.int64)
    far[13:27] = 40
    return code_lengths(counts), code_lengths(far)


@lru_cache
def usual() -> tuple[PrefixCode, PrefixCode]:
    return tuple(map(PrefixCode, usual_codes()))


def pack(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bits of the values, least significant first, one after the other."""
    ends = np.cumsum(sizes)
    of = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)
    return (values[of] >> at.astype(np.uint64) & np.uint64(1)).astype(np.uint8)


def codes_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``unspread`` of an array."""
    v = values.astype(np.int64) - 1
    top = np.zeros(len(v), np.int64)
    for k in (16, 8, 4, 2, 1):
        big = v >> (top + k) > 0
        top[big] += k
    small = v < 4
    extra = np.where(small, 0, top - 1)
    code = np.where(small, v, 2 * top + (v >> np.maximum(top - 1, 0) & 1))
    return code, extra, np.where(small, 0, v & (1 << extra) - 1)


def write_green(bits: BitWriter, green: np.ndarray, alpha: int) -> np.ndarray:
    """One entropy-coded image whose red and blue are 0 and whose alpha is constant, as bits."""
    found = matches(green)
    literal = np.ones(len(green), bool)
    for start, length, _ in found:
        literal[start : start + length] = False
    starts, lengths, fars = np.array(found, np.int64).reshape(-1, 3).T
    l_code, l_extra, l_value = codes_of(lengths)
    d_code, d_extra, d_value = codes_of(fars + 120)
    if len(green) >= OWN_CODES:
        counts = np.bincount(green[literal], minlength=280)
        np.add.at(counts, 256 + l_code, 1)
        one, two = PrefixCode(code_lengths(counts)), PrefixCode(code_lengths(np.bincount(d_code, minlength=40)))
    else:
        one, two = usual()
    bits.write(0, 2)  # no colour cache, no meta prefix codes
    head = [as_bits(bits), code_bits(one.lengths.tobytes()), code_bits(lone(0)), code_bits(lone(0)), code_bits(lone(alpha)), code_bits(two.lengths.tobytes())]
    code, size = one.arrays()
    d_bits, d_size = two.arrays()
    places = np.flatnonzero(literal)
    first = size[256 + l_code]
    second, third = first + l_extra, first + l_extra + d_size[d_code]
    as_u = lambda x: x.astype(np.uint64)
    copies = code[256 + l_code] | as_u(l_value) << as_u(first) | d_bits[d_code] << as_u(second) | as_u(d_value) << as_u(third)
    order = np.argsort(np.concatenate([places, starts]), kind="stable")
    values = np.concatenate([code[green[places]], copies])[order]
    sizes = np.concatenate([size[green[places]], third + d_extra])[order]
    return np.concatenate([*head, pack(values, sizes)])


def lone(symbol: int) -> bytes:
    """The code lengths of an alphabet of which one symbol is used."""
    return bytes(symbol) + b"\1"


@lru_cache(maxsize=64)
def code_bits(lengths: bytes) -> np.ndarray:
    bits = BitWriter()
    write_code(bits, list(lengths))
    return as_bits(bits)


@lru_cache(maxsize=64)
def plain_image(argb: int) -> tuple[int, int]:
    """An entropy-coded image of one colour, of any size, as (bits, their number)."""
    bits = BitWriter()
    write_image(bits, [argb], 1, False, False, 0)
    found = as_bits(bits)
    return int("".join(map(str, found[::-1].tolist())), 2), len(found)


def as_bits(writer: BitWriter) -> np.ndarray:
    tail = [writer.value >> k & 1 for k in range(writer.bits)]
    return np.concatenate([np.unpackbits(np.frombuffer(bytes(writer.out), np.uint8), bitorder="little"), np.array(tail, np.uint8)])


def cost(green: np.ndarray) -> float:
    """Bits of the samples under a code of their own."""
    counts = np.bincount(green, minlength=256)
    counts = counts[counts > 0]
    return float(-(counts * np.log2(counts / len(green))).sum())


def residuals(grid: np.ndarray, mode: int) -> np.ndarray:
    """Samples less their left (mode 1) or upper (2) neighbours; edges as the format has them."""
    out = grid.copy()
    if mode == 1:
        out[:, 1:] -= grid[:, :-1]
        out[1:, 0] -= grid[:-1, 0]
    else:
        out[1:] -= grid[:-1]
        out[0, 1:] -= grid[0, :-1]
    return out


def encode_samples(payload: np.ndarray) -> bytes:
    """Samples (uint8) as the grey pixels of an image; the last row is filled up with zeros."""
    width, height = shape(len(payload))
    green = np.zeros(width * height, np.uint8)
    green[: len(payload)] = payload
    bits, used = begin(width, height), np.flatnonzero(np.bincount(green, minlength=256))
    if len(used) <= 16:
        rank = np.zeros(256, np.uint8)
        rank[used] = np.arange(len(used))
        bits.write(1, 1)
        bits.write(PALETTE, 2)
        write_palette(bits, 0xFF000000 | used.astype(np.uint32) * 0x010101)
        index, width = pack_rows(rank[green], width, height, len(used))
        green = index.astype(np.uint8)
    else:
        bits.write(1, 1)
        bits.write(CROSS_COLOUR, 2)
        bits.write(7, 3)
        # Green goes to red and blue as it is: 32 / 32 of it.
        bits.write(*plain_image(0xFF000000 | 32 << 8 | 32))
    grid, alpha = green.reshape(height, width), 255
    plain = cost(green)
    for mode in (1, 2):
        less = residuals(grid, mode)
        if cost(less.reshape(-1)) < 0.9 * plain - 200:
            bits.write(1, 1)
            bits.write(PREDICTOR, 2)
            bits.write(7, 3)
            bits.write(*plain_image(0xFF000000 | mode << 8))
            green, alpha = less.reshape(-1), 0
            break
    bits.write(0, 1)
    return container(np.packbits(write_green(bits, green, alpha), bitorder="little").tobytes())


def samples(argb: np.ndarray) -> np.ndarray:
    """The samples that ``encode_samples`` took."""
    return (argb >> np.uint32(8)).astype(np.uint8)


def write_palette(bits: BitWriter, table: np.ndarray) -> None:
    bits.write(len(table) - 1, 8)
    by = table.astype("<u4").view(np.uint8).reshape(-1, 4)
    delta = np.diff(by, axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8)
    write_image(bits, delta.view("<u4").reshape(-1).tolist(), len(table), False, False, 0)


def pack_rows(index: np.ndarray, width: int, height: int, colours: int) -> tuple[np.ndarray, int]:
    """Palette indices, several to a pixel where there are few colours; and the new width."""
    each = palette_pack(colours)
    rows, inner = index.reshape(height, width), (width + (1 << each) - 1) >> each
    if each:
        depth = 8 >> each
        rows = np.pad(rows, ((0, 0), (0, (inner << each) - width))).reshape(height, inner, 1 << each)
        rows = (rows.astype(np.int64) << (np.arange(1 << each) * depth)).sum(axis=2)
    return rows.reshape(-1), inner


def write_image(bits: BitWriter, argb: list[int], width: int, top: bool, runs: bool, cache_bits: int) -> None:
    """One entropy-coded image with runs as back-references and a colour cache."""
    ops, at, cache = [], 0, [None] * (1 << cache_bits if cache_bits else 0)
    slot = lambda p: (CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> (32 - cache_bits)
    while at < len(argb):
        length = 0
        for far in (1, width) if runs else ():
            k = 0
            while far <= at and at + k < len(argb) and k < 4096 and argb[at + k] == argb[at + k - far]:
                k += 1
            if k > length:
                length, back = k, far
        if length >= 3:
            ops.append(("copy", length, back))
        elif cache and cache[slot(argb[at])] == argb[at]:
            ops.append(("cache", slot(argb[at])))
            length = 1
        else:
            ops.append(("pixel", argb[at]))
            length = 1
        for p in argb[at : at + length]:
            if cache:
                cache[slot(p)] = p
        at += length
    counts = [np.zeros(n, np.int64) for n in (280 + len(cache), 256, 256, 256, 40)]
    short = {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(SHORT_DISTANCES)))}
    coded = []
    for op in ops:
        if op[0] == "pixel":
            a, r, g, b = channels(op[1])
            coded.append([(0, g), (1, r), (2, b), (3, a)])
        elif op[0] == "cache":
            coded.append([(0, 280 + op[1])])
        else:
            c, n, v = unspread(op[1])
            d, m, w = unspread(short.get(op[2], op[2] + 120))
            coded.append([(0, 256 + c), (None, v, n), (4, d), (None, w, m)])
        for x in coded[-1]:
            if x[0] is not None:
                counts[x[0]][x[1]] += 1
    bits.write(1 if cache else 0, 1)
    if cache:
        bits.write(cache_bits, 4)
    if top:
        bits.write(0, 1)
    codes = [write_code(bits, code_lengths(c)) for c in counts]
    for group in coded:
        for x in group:
            if x[0] is None:
                bits.write(x[1], x[2])
            else:
                codes[x[0]].write(bits, x[1])


def encode(argb: np.ndarray, width: int, height: int, transforms=(), runs: bool = True, cache_bits: int = 0, mode: int = 11, shift=(3, 5, 7)) -> bytes:
    """Any ARGB image with the given transforms, in the order given."""
    bits, full, inner = begin(width, height), np.asarray(argb, np.uint32), width
    for kind in transforms:
        bits.write(1, 1)
        bits.write(kind, 2)
        if kind == SUBTRACT_GREEN:
            green = (full >> 8) & 255
            full = (full & 0xFF00FF00) | ((((full >> 16) & 255) - green & 255) << 16) | ((full & 255) - green & 255)
        elif kind == PALETTE:
            table, index = np.unique(full, return_inverse=True)
            if len(table) > 256:
                raise ValueError("more than 256 colours")
            write_palette(bits, table)
            rows, inner = pack_rows(index, inner, height, len(table))
            full = (rows.reshape(-1).astype(np.uint32) << 8) | 0xFF000000
        else:
            b = 2
            bits.write(b - 2, 3)
            across, down = (inner + 3) >> b, (height + 3) >> b
            if kind == PREDICTOR:
                blocks = np.full(across * down, 0xFF000000 | mode << 8, np.uint32)
                plain = full.tolist()
                full = np.array([subtract(p, predicted(plain, k, inner, blocks, b, across)) for k, p in enumerate(plain)], np.uint32)
            else:
                blocks = np.full(across * down, 0xFF000000 | shift[2] << 16 | shift[1] << 8 | shift[0], np.uint32)
                full = colour_shift(full, inner, height, blocks, b, -1)
            write_image(bits, blocks.tolist(), across, False, True, 0)
    bits.write(0, 1)
    write_image(bits, full.tolist(), inner, True, runs, cache_bits)
    return container(bits.done())
