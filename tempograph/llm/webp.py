"""Lossless WebP (VP8L): a decoder of the whole format, and an encoder that can make use of each of its parts.

Pictures are arrays of height x width numbers 0xAARRGGBB. The decoder makes the next bits at every bit
position of a stretch of the stream at once, and finds each symbol and its length by one look into a code's table.
"""

from __future__ import annotations

import functools
import itertools
import math
import struct

import numpy as np

# Fixed values of the format: the order in which lengths of the code-length code are stored, and the near
# neighbours (x to the left, y up) that the first 120 distance codes stand for.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3),
    (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5),
    (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7),
    (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6),
    (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
HASH = 0x1E35A7BD
PREDICTOR, CROSS, GREEN, PALETTE = range(4)
STRETCH = 1 << 18


class WebPError(ValueError):
    """The bytes are not a lossless WebP picture."""


# --- prefix codes


#: Stretches of 16 bits whose lengths a code of lengths remembers.
CHUNKS = 1 << 14


class Code:
    """A canonical prefix code by its lengths; tables for as many bits as the longest code has."""

    def __init__(self, lengths: np.ndarray):
        used = lengths.nonzero()[0]
        if len(used) == 0:
            raise WebPError("a code without symbols")
        self.most = int(used[-1])
        self.lengths, self.single = lengths, int(used[0]) if len(used) == 1 else None
        self.bits = 0 if self.single is not None else int(lengths.max())
        if self.single is not None:
            self.symbol, self.length = np.array([self.single]), np.zeros(1, "uint8")
            return
        order = used[np.argsort(lengths[used], kind="stable")]
        share = 1 << (self.bits - lengths[order].astype("int64"))
        if share.sum() != 1 << self.bits:
            raise WebPError("a code that is not full")
        left = np.repeat(order, share)[reversed_bits(self.bits)]
        self.symbol, self.length = left, lengths[left]

    def table(self, shift: int) -> list[int]:
        """symbol << shift << 6 | length for each value of the next `bits` bits."""
        return (self.symbol << (shift + 6) | self.length).tolist()

    @functools.cached_property
    def chunks(self) -> dict[int, tuple[bytes, int, int]]:
        return {}

    def chunk(self, word: int) -> tuple[bytes, int, int]:
        """Of a code of lengths: the lengths that 16 bits tell whatever comes before and after, those bits' number, and the last length above 0, or 0."""
        out, at, last = b"", 0, 0
        while at < 16 and self.bits:
            k = word >> at & ((1 << self.bits) - 1)
            symbol, end = int(self.symbol[k]), at + int(self.length[k])
            extra = (2, 3, 7)[symbol - 16] if symbol > 15 else 0
            if end + extra > 16 or (symbol == 16 and not last):
                break
            more = word >> end & ((1 << extra) - 1)
            out += bytes([symbol]) if symbol < 16 else bytes([last]) * (3 + more) if symbol == 16 else bytes((3, 11)[symbol - 17] + more)
            last, at = symbol if 0 < symbol < 16 else last, end + extra
        if len(self.chunks) >= CHUNKS:
            self.chunks.clear()
        return self.chunks.setdefault(word, (out, at, last))

    @functools.cached_property
    def codes(self) -> np.ndarray:
        return codes_of(self.lengths)


@functools.lru_cache(maxsize=16)
def reversed_bits(n: int) -> np.ndarray:
    x, out = np.arange(1 << n), np.zeros(1 << n, "int64")
    for k in range(n):
        out |= ((x >> k) & 1) << (n - 1 - k)
    return out


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """The words of the canonical code with these lengths, their first bit lowest."""
    used = lengths.nonzero()[0]
    order = used[np.argsort(lengths[used], kind="stable")]
    size = lengths[order].astype("int64")
    share = 1 << (int(size[-1]) - size)
    words = np.zeros(len(lengths), "uint64")
    words[order] = reversed_bits(int(size[-1]))[np.cumsum(share) - share] if len(order) > 1 else 0
    return words


@functools.lru_cache(maxsize=256)
def code_of(lengths: bytes) -> Code:
    return Code(np.frombuffer(lengths, "uint8"))


def huffman(counts: np.ndarray, most: int) -> np.ndarray:
    """Lengths of an optimal code, flattened until none exceeds `most`; ties go by symbol."""
    used = counts.nonzero()[0].tolist()
    lengths = np.zeros(len(counts), "uint8")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    weights, m, none = counts[used].astype("int64").tolist(), len(used), 1 << 62
    while True:
        order = sorted(range(m), key=weights.__getitem__)
        leaves, nodes, parent = [*(weights[k] for k in order), none], [none] * m, [0] * (2 * m - 1)  # leaves by weight, and what they merge into
        leaf = inner = 0
        for n in range(m - 1):
            if leaves[leaf] <= nodes[inner]:
                total = leaves[leaf]
                parent[leaf] = m + n
                leaf += 1
            else:
                total = nodes[inner]
                parent[m + inner] = m + n
                inner += 1
            if leaves[leaf] <= nodes[inner]:
                total += leaves[leaf]
                parent[leaf] = m + n
                leaf += 1
            else:
                total += nodes[inner]
                parent[m + inner] = m + n
                inner += 1
            nodes[n] = total
        n = 2 * m - 1
        depth = [0] * n
        for k in range(n - 2, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth) <= most:
            for k, place in enumerate(order):
                lengths[used[place]] = depth[k]
            return lengths
        weights = [w // 2 + 1 for w in weights]


# --- reading

#: The last few descriptions of codes by alphabet: (bits, value, code).
DESCRIBED: dict[int, list[tuple]] = {}


@functools.lru_cache(maxsize=256)
def sizes_of(n: int, bits: int) -> bytes:
    """The lengths of a code-length code of which the first n are told, three bits each."""
    sizes = bytearray(19)
    for k, place in enumerate(LENGTH_ORDER[:n]):
        sizes[place] = bits >> (3 * k) & 7
    return bytes(sizes)


class Bits:
    """Bits of bytes, the lowest of each byte first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def peek(self) -> int:
        """At least 56 bits from here on; zeros beyond the end."""
        return int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 8], "little") >> (self.at & 7)

    def read(self, n: int) -> int:
        if self.at + n > self.end:
            raise WebPError("the stream ends early")
        x = self.peek() & ((1 << n) - 1)
        self.at += n
        return x

    def symbol(self, code: Code) -> int:
        k = self.peek() & ((1 << code.bits) - 1)
        self.at += int(code.length[k])
        if self.at > self.end:
            raise WebPError("the stream ends early")
        return int(code.symbol[k])

    def number(self, prefix: int) -> int:
        """A length or a distance code from its prefix and extra bits."""
        if prefix < 4:
            return prefix + 1
        extra = (prefix - 2) >> 1
        return ((2 + (prefix & 1)) << extra) + self.read(extra) + 1

    def code(self, size: int) -> Code:
        """The code that is described here. A description is known again by its bits: it tells itself where it ends."""
        known, here = DESCRIBED.setdefault(size, []), self.at
        for n, value, code in known:
            if here + n <= self.end and (int.from_bytes(self.data[here >> 3 : (here + n + 7) >> 3], "little") >> (here & 7)) & ((1 << n) - 1) == value:
                self.at += n
                return code
        code = self.described(size)
        n = self.at - here
        known.append((n, (int.from_bytes(self.data[here >> 3 : (self.at + 7) >> 3], "little") >> (here & 7)) & ((1 << n) - 1), code))
        del known[:-4]
        return code

    def described(self, size: int) -> Code:
        lengths = bytearray(size)
        if self.read(1):
            two = self.read(1)
            for k in range(two + 1):
                symbol = self.read(8 if k or self.read(1) else 1)
                if symbol >= size:
                    raise WebPError("a symbol beyond the alphabet")
                lengths[symbol] = 1
            return code_of(bytes(lengths))
        n = 4 + self.read(4)
        inner = code_of(sizes_of(n, self.read(3 * min(n, 10)) | self.read(3 * max(n - 10, 0)) << 30))
        rest = 2 + self.read(2 + 2 * self.read(3)) if self.read(1) else size
        at, last = 0, 8
        symbols, widths, mask, data = inner.symbol.tolist(), inner.length.tolist(), (1 << inner.bits) - 1, self.data
        here, word, known, chunks, free = self.at, 0, 0, inner.chunks, rest == size
        while at < size and rest:
            if known < 18:
                known = 2048 - (here & 7)
                word = int.from_bytes(data[here >> 3 : (here >> 3) + 256], "little") >> (here & 7)
            if free:
                chunk = chunks.get(word & 0xFFFF) or inner.chunk(word & 0xFFFF)
                if chunk[1] and (end := at + len(chunk[0])) <= size:
                    lengths[at:end] = chunk[0]
                    at = end
                    last = chunk[2] or last
                    word >>= chunk[1]
                    here += chunk[1]
                    known -= chunk[1]
                    continue
            rest -= 1
            symbol, width = symbols[word & mask], widths[word & mask]
            word >>= width
            if symbol < 16:
                if symbol:
                    lengths[at] = last = symbol
                at += 1
            else:
                base, extra, value = ((3, 2, last), (3, 3, 0), (11, 7, 0))[symbol - 16]
                n = base + (word & ((1 << extra) - 1))
                word >>= extra
                width += extra
                if at + n > size:
                    raise WebPError("more lengths than symbols")
                lengths[at : at + n] = bytes([value]) * n
                at += n
            here += width
            known -= width
        self.at = here
        if self.at > self.end:
            raise WebPError("the stream ends early")
        return code_of(bytes(lengths))


class Cache:
    """Recently seen colours by a hash; pixels enter, in order, when somebody asks."""

    def __init__(self, bits: int):
        self.shift, self.held, self.upto = 32 - bits, [0] * (1 << bits), 0

    def colour(self, k: int, pixels: np.ndarray, n: int) -> int:
        for x in pixels[self.upto : n].tolist():
            self.held[(x * HASH & 0xFFFFFFFF) >> self.shift] = x
        self.upto = n
        return self.held[k]


def picture(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Width x height pixels, coded with one group of codes or, of the main picture, with a group for each block."""
    cached = bits.read(4) if bits.read(1) else 0
    if cached > 11:
        raise WebPError("too large a colour cache")
    which, grain, n_groups = None, 0, 1
    if main and bits.read(1):
        grain = bits.read(3) + 2
        which = (picture(bits, (width + (1 << grain) - 1) >> grain, (height + (1 << grain) - 1) >> grain, False) >> 8) & 0xFFFF
        n_groups = int(which.max()) + 1
    groups = [[bits.code(n) for n in (280 + ((1 << cached) if cached else 0), 256, 256, 256, 40)] for _ in range(n_groups)]
    out, total, n = np.zeros(width * height, "uint32"), width * height, 0
    cache = Cache(cached) if cached else None
    if n_groups == 1:
        return pixels_of(bits, groups[0], cache, total, width).reshape(height, width)
    while n < total:
        group = groups[int(which[n // width >> grain, n % width >> grain])]
        symbol = bits.symbol(group[0])
        if symbol < 256:
            red, blue, alpha = (bits.symbol(c) for c in group[1:4])
            out[n] = alpha << 24 | red << 16 | symbol << 8 | blue
            n += 1
        elif symbol < 280:
            length = bits.number(symbol - 256)
            n = copied(out, n, length, far_back(bits.number(bits.symbol(group[4])), width))
        else:
            out[n] = cache.colour(symbol - 280, out, n)
            n += 1
    return out.reshape(height, width)


def far_back(code: int, width: int) -> int:
    return code - 120 if code > 120 else max(1, NEAR[code - 1][0] + NEAR[code - 1][1] * width)


def copied(out: np.ndarray, n: int, length: int, distance: int) -> int:
    """Repeat pixels from a distance back; the number of pixels then known."""
    if distance > n or n + length > len(out):
        raise WebPError("a reference out of the picture")
    done = 0
    while done < length:
        step = min(length - done, distance + done)
        out[n + done : n + done + step] = out[n - distance : n - distance + step]
        done += step
    return n + length


#: Extra bits of length and distance prefixes, and the numbers that those bits are added to.
EXTRA = np.array([max(0, (k - 2) >> 1) for k in range(40)])
FIRST = np.array([k + 1 if k < 4 else ((2 + (k & 1)) << ((k - 2) >> 1)) + 1 for k in range(40)])
EIGHT = np.arange(8)
PREFIX = list(zip(EXTRA.tolist(), FIRST.tolist(), strict=True))


def pixels_of(bits: Bits, group: list[Code], cache: Cache | None, total: int, width: int) -> np.ndarray:
    """All pixels of a picture with one group of codes.

    For each bit of a stretch of the stream it is found at once where a pixel that begins there would end; one walk over these ends gives
    where pixels do begin, and their colours are read at once. References and the colour cache come last (see filled).
    """
    green, red, blue, alpha, far = group
    in_green, in_red, in_blue, in_alpha = ((1 << c.bits) - 1 for c in group[:4])
    if not any(c.bits for c in group[:4]) and green.single < 256:
        return np.full(total, alpha.single << 24 | red.single << 16 | green.single << 8 | blue.single, "uint32")
    by_green = green.symbol << 4 | green.length
    in_far, by_far = (1 << far.bits) - 1, None
    x, slot, references = np.zeros(total, "uint32"), np.full(total, -1, "int16"), []
    n = 0
    while n < total:
        base = bits.at & ~7
        raw = np.frombuffer(bits.data, "uint8", min(len(bits.data) - (base >> 3), STRETCH // 8 + 16), base >> 3)
        if not len(raw):
            raise WebPError("the stream ends early")
        b = np.zeros(len(raw) + 19, "int64")  # zeros beyond the end
        b[: len(raw)] = raw
        word = b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24
        window, wide = (word[:, None] >> EIGHT).reshape(-1), memoryview(word)  # 25 bits or more from each bit on
        p, began, last = bits.at - base, n, 8 * len(raw)
        limit = last - 64 if (base >> 3) + len(raw) < len(bits.data) else last + 1
        told = by_green.take(window & in_green, mode="clip")
        after = np.arange(len(window))
        after += told & 15
        ends, width_of = after, None
        for code, mask in ((red, in_red), (blue, in_blue), (alpha, in_alpha)):
            if code.bits:
                if width_of is None or code is not known:
                    width_of, known = code.length.astype("int64").take(window & mask, mode="clip"), code
                ends = ends + width_of.take(ends, mode="clip")
        if green.most > 255:
            others = (told >= 256 << 4).nonzero()[0]
            ends[others] = np.where(told[others] < 280 << 4, -1, after[others])
        ends[limit:] = -1
        begins: list[int] = []
        place, add, steps = [], begins.append, memoryview(ends)
        while n < total and p < limit:
            held = len(begins)
            for _ in itertools.repeat(None, total - n):
                q = steps[p]
                if q < 0:
                    break
                add(p)
                p = q
            if len(begins) > held:
                place.append((n, held, len(begins)))
                n += len(begins) - held
            if n == total or p >= limit:
                break
            if by_far is None:
                by_far = far.table(0)
            t = int(told[p])
            p += t & 15
            extra, first = PREFIX[(t >> 4) - 256]
            length = first + (wide[p >> 3] >> (p & 7) & ((1 << extra) - 1))
            p += extra
            t = by_far[int(window[p]) & in_far]
            p += t & 63
            extra, first = PREFIX[t >> 6]
            code = first + (wide[p >> 3] >> (p & 7) & ((1 << extra) - 1))
            p += extra
            distance = far_back(code, width)
            if distance > n or n + length > total:
                raise WebPError("a reference out of the picture")
            references.append((n, length, distance))
            n += length
        bits.at = base + p
        if bits.at > bits.end or n == began:
            raise WebPError("the stream ends early")
        at = np.array(begins, "int64")
        symbol = told.take(at)
        at += symbol & 15
        symbol >>= 4
        colour = symbol.astype("uint32") << 8
        for code, mask, shift in ((red, in_red, 16), (blue, in_blue, 0), (alpha, in_alpha, 24)):
            if code.bits:
                k = window.take(at, mode="clip") & mask
                colour |= code.symbol.take(k).astype("uint32") << shift
                at += code.length.take(k)
            else:
                colour |= np.uint32(code.single << shift)
        hit = symbol.astype("int16") - 280 if cache else None
        for first, low, high in place:
            x[first : first + high - low] = colour[low:high]
            if cache:
                slot[first : first + high - low] = hit[low:high]
    return filled(x, slot, references, cache.shift if cache else 0)


def filled(x: np.ndarray, slot: np.ndarray, references: list[tuple[int, int, int]], shift: int) -> np.ndarray:
    """Pixels with what references (begin, length, distance) and the colour cache of 32 - shift bits stand for; slot: a pixel's
    place in the cache where that is all that is known of it, else below 0. Without a cache (shift 0) slots are not read."""
    if not shift:
        for n, length, distance in references:
            copied(x, n, length, distance)
        return x
    hits = slot >= 0
    if not hits.any():
        return filled(x, slot, references, 0)
    known = np.where(hits, slot, ((x * np.uint32(HASH)) >> np.uint32(shift)).astype("int16"))
    source = np.arange(len(x))
    for n, length, distance in references:
        copied(known, n, length, distance)
        hits[n : n + length] = False
        if distance >= length:
            source[n : n + length] -= distance
        else:
            source[n : n + length] = np.arange(length) % distance + (n - distance)
    order = np.argsort(known, kind="stable")  # a cached pixel is the last one before it of its place that is not cached itself
    place, own = known[order], ~hits[order]
    latest = np.maximum.accumulate(np.where(own, np.arange(len(x)), -1))
    held = (latest >= 0) & (place[latest] == place)
    if not held.all():
        return filled_in_turn(x, slot, references, shift)
    found = order[latest]
    source[order] = np.where(own, source[order], found)
    while not ((further := source[source]) == source).all():
        source = further
    return x[source]


def filled_in_turn(x: np.ndarray, slot: np.ndarray, references: list[tuple[int, int, int]], shift: int) -> np.ndarray:
    """The same, pixel by pixel, where a place of the cache is read that holds nothing yet: that is black and transparent, and enters the cache as such."""
    held, out, by = [0] * (1 << (32 - shift)), x.tolist(), {n: (length, distance) for n, length, distance in references}
    places, left, back = slot.tolist(), 0, 0
    for n in range(len(out)):
        left, back = by.get(n, (left - 1, back))
        if left > 0:
            out[n] = out[n - back]
        elif places[n] >= 0:
            out[n] = held[places[n]]
        held[(out[n] * HASH & 0xFFFFFFFF) >> shift] = out[n]
    return np.array(out, "uint32")


# --- transforms


def halves(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def predicted(mode: int, left, top, above_right, above_left) -> np.ndarray:
    """What a mode foretells from four neighbours; rows of four channels, as signed numbers. Modes 14 and 15 are as 0."""
    if mode in (0, 14, 15):
        return np.broadcast_to(np.array([255, 0, 0, 0], "int32"), np.shape(top))
    if mode < 5:
        return (left, top, above_right, above_left)[mode - 1]
    if mode == 5:
        return halves(halves(left, above_right), top)
    if mode < 10:
        return halves(*((left, above_left), (left, top), (above_left, top), (top, above_right))[mode - 6])
    if mode == 10:
        return halves(halves(left, above_left), halves(top, above_right))
    if mode == 11:
        by_left, by_top = np.abs(top - above_left).sum(-1), np.abs(left - above_left).sum(-1)
        return np.where((by_left < by_top)[..., None], left, top)
    if mode == 12:
        return np.clip(left + top - above_left, 0, 255)
    mean = halves(left, top)
    half = mean - above_left
    return np.clip(mean + np.trunc(half / 2).astype("int32"), 0, 255)


def channels(x: np.ndarray) -> np.ndarray:
    return np.stack([(x >> s) & 255 for s in (24, 16, 8, 0)], axis=-1).astype("int32")


def joined(x: np.ndarray) -> np.ndarray:
    x = (x & 255).astype("uint32")
    return x[..., 0] << 24 | x[..., 1] << 16 | x[..., 2] << 8 | x[..., 3]


def neighbours(x: np.ndarray, row: int, column: int) -> tuple:
    width = x.shape[1]
    right = x[row - 1, column + 1] if column + 1 < width else x[row, 0]
    return x[row, column - 1], x[row - 1, column], right, x[row - 1, column - 1]


def unpredicted(rest: np.ndarray, modes: np.ndarray, grain: int) -> np.ndarray:
    """Pixels from residuals. Where a row's modes look upward or to the left alone, each run of one mode is done at once, others pixel by pixel."""
    x = channels(rest)
    height, width = rest.shape
    x[0, 0] += (255, 0, 0, 0)
    x[0] = np.cumsum(x[0], axis=0) & 255
    x[0, 0] &= 255
    for row in range(1, height):
        own = np.repeat((modes[row >> grain] >> 8) & 15, 1 << grain)[:width]
        x[row, 0] = (x[row, 0] + x[row - 1, 0]) & 255
        if width > 1 and np.isin(own[1:], (0, 1, 2, 3, 4, 8, 9)).all():
            right = np.concatenate([x[row - 1, 2:], x[row, :1]])
            begins = np.flatnonzero(np.diff(own[1:], prepend=-1)) + 1
            for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), width], strict=True):
                if own[begin] == 1:
                    x[row, begin - 1 : end] = np.cumsum(x[row, begin - 1 : end], axis=0) & 255
                else:
                    x[row, begin:end] = (x[row, begin:end] + predicted(int(own[begin]), None, x[row - 1, begin:end], right[begin - 1 : end - 1], x[row - 1, begin - 1 : end - 1])) & 255
            continue
        for column in range(1, width):
            x[row, column] = (x[row, column] + predicted(int(own[column]), *neighbours(x, row, column))) & 255
    return joined(x)


def signed(x: np.ndarray) -> np.ndarray:
    return ((x & 255) ^ 128) - 128


def crossed(x: np.ndarray, blocks: np.ndarray, grain: int, sign: int) -> np.ndarray:
    """Add (or, forward, take away) what blocks say that green and red tell of red and blue."""
    height, width = x.shape
    c = channels(x)
    by = channels(np.repeat(np.repeat(blocks, 1 << grain, 0), 1 << grain, 1)[:height, :width])
    told = lambda t, v: (signed(t) * signed(v)) >> 5
    before = c[..., 1].copy()
    c[..., 1] += sign * told(by[..., 3], c[..., 2])
    red = c[..., 1] if sign > 0 else before
    c[..., 3] += sign * (told(by[..., 2], c[..., 2]) + told(by[..., 1], red & 255))
    return joined(c)


def greened(x: np.ndarray, sign: int) -> np.ndarray:
    c = channels(x)
    c[..., 1] += sign * c[..., 2]
    c[..., 3] += sign * c[..., 2]
    return joined(c)


def palette_bits(size: int) -> int:
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def unpaletted(x: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    """Colours by index; an index beyond the palette is transparent black."""
    shift = palette_bits(len(palette))
    index = (x >> np.uint32(8)) & np.uint32(255)
    if shift:
        depth = 8 >> shift
        index = ((index[:, :, None] >> (np.arange(1 << shift, dtype="uint32") * depth)) & ((1 << depth) - 1)).reshape(len(x), -1)[:, :width]
    return np.append(palette, np.zeros(256, "uint32"))[index]


def decode(data: bytes) -> np.ndarray:
    """The picture of one file."""
    if len(data) < 21 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise WebPError("no lossless WebP")
    size = struct.unpack_from("<I", data, 16)[0]
    if 20 + size > len(data) or data[20] != 0x2F:
        raise WebPError("a broken header")
    bits = Bits(data[21 : 20 + size])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise WebPError("an unknown version")
    transforms, now = [], width
    while bits.read(1):
        kind = bits.read(2)
        if any(k == kind for k, *_ in transforms):
            raise WebPError("a transform comes twice")
        if kind in (PREDICTOR, CROSS):
            grain = bits.read(3) + 2
            transforms.append((kind, picture(bits, (now + (1 << grain) - 1) >> grain, (height + (1 << grain) - 1) >> grain, False), grain))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            palette = joined(np.cumsum(channels(picture(bits, n, 1, False)[0]), axis=0))
            transforms.append((kind, palette, now))
            shift = palette_bits(n)
            now = (now + (1 << shift) - 1) >> shift
        else:
            transforms.append((kind, None, 0))
    x = picture(bits, now, height, True)
    for kind, by, n in reversed(transforms):
        x = unpredicted(x, by, n) if kind == PREDICTOR else crossed(x, by, n, 1) if kind == CROSS else greened(x, 1) if kind == GREEN else unpaletted(x, by, n)
    return x


# --- writing


class Writer:
    def __init__(self):
        self.value, self.size = 0, 0

    def put(self, x: int, n: int) -> None:
        self.value |= x << self.size
        self.size += n

    def code(self, lengths: np.ndarray) -> None:
        self.put(*description(lengths.tobytes()))

    def describe(self, lengths: np.ndarray, by: np.ndarray | None = None) -> None:
        """A code by its lengths, which are written in the code `by`, or in one that fits them best."""
        used = np.flatnonzero(lengths).tolist()
        if len(used) <= 2 and max(used) < 256:
            self.put(1 | (len(used) - 1) << 1 | 1 << 2, 3)
            for symbol in used:
                self.put(symbol, 8)
            return
        runs = runs_of(lengths)
        sizes = huffman(np.bincount([r[0] for run in runs for r in run_lengths(*run)], minlength=19), 7) if by is None else by
        if np.count_nonzero(sizes) == 1:  # a lone symbol has no bits of its own; a second makes the code full
            sizes[17 if sizes[17] == 0 else 18] = 1
        key = sizes.tobytes()
        value, size = sizes_told(key)
        for x, n, again in runs:
            word, width = run_word(key, x, n, again)
            value |= word << size
            size += width
        self.put(value, size)


@functools.lru_cache(maxsize=16)
def sizes_told(sizes: bytes) -> tuple[int, int]:
    """What comes before a description: the code-length code, as a number and its bits."""
    stored = [sizes[k] for k in LENGTH_ORDER]
    while len(stored) > 4 and not stored[-1]:
        stored.pop()
    return sum(n << (5 + 3 * k) for k, n in enumerate(stored)) | (len(stored) - 4) << 1, 6 + 3 * len(stored)


@functools.lru_cache(maxsize=16)
def words_of(lengths: bytes) -> list[int]:
    return codes_of(np.frombuffer(lengths, "uint8")).tolist()


@functools.lru_cache(maxsize=64)
def description(lengths: bytes) -> tuple[int, int]:
    """A code's description, as a number and its bits."""
    out = Writer()
    out.describe(np.frombuffer(lengths, "uint8"))
    return out.value, out.size


def runs_of(lengths: np.ndarray) -> list[tuple[int, int, bool]]:
    """(length, times, whether it is the last one above 0, or the 8 that all begin with)."""
    begins, last, out = (lengths[1:] != lengths[:-1]).nonzero()[0] + 1, 8, []
    at, body = 0, lengths.tobytes()
    for end in (*begins.tolist(), len(body)):
        x = body[at]
        out.append((x, end - at, x == last))
        last, at = x or last, end
    return out


def run_lengths(x: int, n: int, again: bool):
    """(symbol, extra, bits of extra) of the code-length code; repeats of zeros and of the last length are short."""
    if x:
        if not again:
            yield x, 0, 0
            n -= 1
        while n >= 3:
            yield 16, min(n, 6) - 3, 2
            n -= min(n, 6)
    else:
        while n >= 11:
            yield 18, min(n, 138) - 11, 7
            n -= min(n, 138)
        if n >= 3:
            yield 17, n - 3, 3
            n = 0
    for _ in range(n):
        yield x, 0, 0


@functools.lru_cache(maxsize=1 << 12)
def run_word(sizes: bytes, x: int, n: int, again: bool) -> tuple[int, int]:
    """A run in the code of these sizes, as a number and its bits."""
    words, value, size = words_of(sizes), 0, 0
    for symbol, extra, width in run_lengths(x, n, again):
        value |= (words[symbol] | extra << sizes[symbol]) << size
        size += sizes[symbol] + width
    return value, size


def packed(head: Writer, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    """The head's bits, then codes of up to 63 bits each."""
    ends = np.cumsum(lengths) + head.size % 64
    starts = ends - lengths
    word, off = starts >> 6, (starts & 63).astype("uint64")
    words = np.zeros(int(ends[-1] + 63 >> 6) + 1 if len(ends) else 1, "uint64")
    if len(word):
        first = np.append(0, (word[1:] != word[:-1]).nonzero()[0] + 1)
        words[word[first]] = np.add.reduceat(codes << off, first)
        over = np.where(off + lengths.astype("uint64") > 64, codes >> ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
        words[word[first] + 1] |= np.add.reduceat(over, first)
    whole = head.size // 64
    words[0] |= np.uint64(head.value >> (64 * whole))
    return (head.value & ((1 << (64 * whole)) - 1)).to_bytes(8 * whole, "little") + words.tobytes()[: (int(ends[-1] if len(ends) else head.size % 64) + 7) // 8]


def prefix(x: int) -> tuple[int, int, int]:
    """A length's or distance code's prefix, extra bits and their number."""
    if x <= 4:
        return x - 1, 0, 0
    top = (x - 1).bit_length() - 1
    second = ((x - 1) >> (top - 1)) & 1
    return 2 * top + second, (x - 1) & ((1 << (top - 1)) - 1), top - 1


def tokens(x: np.ndarray, width: int, cached: int, references: bool) -> list[tuple]:
    """Literals ("p", colour), references ("r", length, distance code) and cached colours ("c", index); greedy."""
    pixels, out, seen, n = x.reshape(-1).tolist(), [], {}, 0
    if not (cached or references):
        return [("p", p) for p in pixels]
    held = [0] * (1 << cached)
    near = {}
    for k, (a, b) in enumerate(NEAR):
        near.setdefault(max(1, a + b * width), k + 1)
    while n < len(pixels):
        length, back = 0, 0
        if references and n + 3 <= len(pixels) and (found := seen.get(tuple(pixels[n : n + 3]))) is not None:
            back = n - found
            while length < 4096 and n + length < len(pixels) and pixels[n + length] == pixels[found + length]:
                length += 1
        index = (pixels[n] * HASH & 0xFFFFFFFF) >> (32 - cached) if cached else 0
        if length >= 3:
            out.append(("r", length, near.get(back, back + 120)))
        elif cached and held[index] == pixels[n]:
            out.append(("c", index))
            length = 1
        else:
            out.append(("p", pixels[n]))
            length = 1
        for k in range(n, n + length):
            seen[tuple(pixels[k : k + 3])] = k
            if cached:
                held[(pixels[k] * HASH & 0xFFFFFFFF) >> (32 - cached)] = pixels[k]
        n += length
    return out


def put_picture(out: Writer, x: np.ndarray, main: bool, cached: int = 0, references: bool = False, grain: int = 0) -> None:
    """A picture with any of the format's parts, symbol by symbol. grain: blocks of 2**grain pixels have codes by turns."""
    height, width = x.shape
    out.put(1 | cached << 1, 5) if cached else out.put(0, 1)
    found = tokens(x, width, cached, references)
    turn = np.zeros((1, 1), "int64")
    if main:
        out.put(1 if grain else 0, 1)
        if grain:
            out.put(grain - 2, 3)
            turn = np.add.outer(np.arange((height + (1 << grain) - 1) >> grain), np.arange((width + (1 << grain) - 1) >> grain)) % 2
            put_picture(out, (turn << 8).astype("uint32"), False)
    sizes = (280 + ((1 << cached) if cached else 0), 256, 256, 256, 40)
    counts = [[np.zeros(n, "int64") for n in sizes] for _ in range(int(turn.max()) + 1)]
    plan, n = [], 0
    for t in found:
        g = int(turn[n // width >> grain, n % width >> grain]) if grain else 0
        if t[0] == "p":
            a, r, e, b = (t[1] >> s & 255 for s in (24, 16, 8, 0))
            plan.append((g, [(0, e, 0, 0), (1, r, 0, 0), (2, b, 0, 0), (3, a, 0, 0)]))
        elif t[0] == "c":
            plan.append((g, [(0, 280 + t[1], 0, 0)]))
        else:
            p, q = prefix(t[1]), prefix(t[2])
            plan.append((g, [(0, 256 + p[0], *p[1:]), (4, q[0], *q[1:])]))
        for k, symbol, _, _ in plan[-1][1]:
            counts[g][k][symbol] += 1
        n += t[1] if t[0] == "r" else 1
    codes = []
    for own in counts:
        codes.append([])
        for c in own:
            if not c.any():
                c[0] = 1
            if np.count_nonzero(c) == 1 and np.flatnonzero(c)[0] > 255:
                c[0] = 1
            lengths = huffman(c, 15)
            out.code(lengths)
            code = code_of(lengths.tobytes())
            codes[-1].append((code.codes.tolist(), code.lengths.tolist()) if code.bits else None)
    end = Writer()
    for g, symbols in plan:
        for k, symbol, extra, width_ in symbols:
            if code := codes[g][k]:
                end.put(code[0][symbol], code[1][symbol])
            if width_:
                end.put(extra, width_)
        if end.size > 512:  # short numbers are quicker
            out.put(end.value, end.size)
            end = Writer()
    out.put(end.value, end.size)


def framed(body: bytes) -> bytes:
    body = b"\x2f" + body
    odd = len(body) % 2
    return b"RIFF" + struct.pack("<I", 12 + len(body) + odd) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + b"\0" * odd


def header(width: int, height: int, alpha: bool) -> Writer:
    if not (1 <= width <= 16384 and 1 <= height <= 16384):
        raise WebPError("a side must have 1 to 16384 pixels")
    out = Writer()
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(int(alpha), 1)
    out.put(0, 3)
    return out


def encode(x: np.ndarray, predictor: np.ndarray | None = None, cross: np.ndarray | None = None, green: bool = False, palette: bool = False, grain: int = 3, cached: int = 0, references: bool = False, blocks: int = 0) -> bytes:
    """A file of the picture that makes use of the parts asked for; for small pictures, as it goes pixel by pixel.

    predictor: a mode for each block of 2**grain pixels; cross: an element 0xAARRGGBB for each; palette: for up to
    256 colours, and not with the other transforms; blocks: as grain of put_picture.
    """
    x = np.ascontiguousarray(x, "uint32")
    height, width = x.shape
    out = header(width, height, bool((x >> 24 != 255).any()))
    if palette:
        colours = np.unique(x)
        if len(colours) > 256:
            raise WebPError("too many colours for a palette")
        out.put(1 | PALETTE << 1, 3)
        out.put(len(colours) - 1, 8)
        put_picture(out, joined(np.diff(channels(colours), axis=0, prepend=0))[None, :], False)
        shift = palette_bits(len(colours))
        index = np.searchsorted(colours, x)
        index = np.pad(index, ((0, 0), (0, -width % (1 << shift))))
        index = (index.reshape(height, -1, 1 << shift) << (np.arange(1 << shift) * (8 >> shift))).sum(-1)
        x = (index << 8 | 0xFF000000).astype("uint32")
    if green:
        out.put(1 | GREEN << 1, 3)
        x = greened(x, -1)
    if cross is not None:
        out.put(1 | CROSS << 1, 3)
        out.put(grain - 2, 3)
        put_picture(out, cross.astype("uint32"), False)
        x = crossed(x, cross.astype("uint32"), grain, -1)
    if predictor is not None:
        out.put(1 | PREDICTOR << 1, 3)
        out.put(grain - 2, 3)
        put_picture(out, (predictor.astype("uint32") << 8) | np.uint32(0xFF000000), False)
        x = residual(x, predictor, grain)
    out.put(0, 1)
    put_picture(out, x, True, cached, references, blocks)
    return framed(out.value.to_bytes((out.size + 7) // 8, "little"))


def residual(x: np.ndarray, modes: np.ndarray, grain: int) -> np.ndarray:
    c, out = channels(x), channels(x)
    height, width = x.shape
    for row in range(height):
        for column in range(width):
            if row and column:
                told = predicted(int(modes[row >> grain, column >> grain]), *neighbours(c, row, column))
            else:
                told = c[row - 1, 0] if row else c[0, column - 1] if column else np.array([255, 0, 0, 0])
            out[row, column] -= told
    return joined(out)


def text_lengths() -> np.ndarray:
    """A code for bytes of text, by a rule: 24 frequent ones have 5 bits, 24 others 9, the rest 10."""
    lengths = np.full(280, 10, "uint8")
    lengths[256:] = 0
    lengths[list(b" \netaoinsrhlducmfpgwybvk")] = 5
    lengths[[*b".,0123456789!ETAOINSRH", 0xC3, 0xFF]] = 9
    return lengths


TEXT = text_lengths()


def encode_samples(samples: np.ndarray, width: int, own_code_from: int) -> bytes:
    """A file of 8-bit samples, three a pixel (red, green, blue), all opaque. Pictures of fewer samples than
    own_code_from use the code for text, others one of their own."""
    lengths = TEXT if len(samples) < own_code_from else np.append(huffman(np.bincount(samples, minlength=256), 15), np.zeros(24, "uint8"))
    height = len(samples) // (3 * width)
    out = header(width, height, False)
    out.put(0, 3)  # no transform, no cache, one group of codes
    for body in (lengths, lengths[:256], lengths[:256]):
        out.code(body)
    out.code(np.eye(1, 256, 255, dtype="uint8")[0])
    out.code(np.eye(1, 40, dtype="uint8")[0])
    code = code_of(lengths.tobytes())
    if not code.bits:
        return framed(out.value.to_bytes((out.size + 7) // 8, "little"))
    c, n = code.codes[samples].reshape(-1, 3), lengths[samples].astype("int64").reshape(-1, 3)
    codes = c[:, 1] | c[:, 0] << n[:, 1].astype("uint64") | c[:, 2] << (n[:, 1] + n[:, 0]).astype("uint64")
    return framed(packed(out, codes, n.sum(axis=1)))


# --- writing payloads

#: The predictor's modes that are tried: each undoes a whole run of pixels at once.
TRIED = (1, 2, 4, 8)
#: Sizes of the colour cache that are tried, as bits.
CACHES = (6,)
#: The code in which the lengths of a payload's codes are written, of lengths 0 to 14 and the three kinds of runs; full.
DESCRIBED_BY = np.array([3, 7, 7, 7, 6, 5, 4, 3, 3, 3, 4, 5, 7, 7, 7, 0, 4, 3, 4], "uint8")
#: The longest code of a payload's picture, so that tables stay small.
DEEPEST = 11


#: n log2 n.
SURPRISE = np.arange(1 << 15) * np.log2(np.maximum(np.arange(1 << 15), 1))


def bits_of(symbols: np.ndarray) -> float:
    """The entropy of all symbols together, and five bits for the description of each distinct one."""
    counts, n = np.bincount(symbols), len(symbols)
    some = counts[counts >= 1 << 15] if n >= 1 << 15 else ()
    low = np.add.reduce(SURPRISE.take(counts, mode="clip")) if not len(some) else SURPRISE[counts[counts < 1 << 15]].sum() + (some * np.log2(some)).sum()
    return float(n * math.log2(max(1, n)) - low) + 5 * int(np.count_nonzero(counts))


def repeats(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """References (begin, length, distance) from left to right: where three pixels come again, to their last occurrence, as far as it goes."""
    none = (np.zeros(0, "int64"),) * 3
    if len(x) < 4:
        return none
    wide = x.astype("uint64") & np.uint64(0xFFFFFF)
    key = wide[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ wide[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ wide[2:] * np.uint64(0x165667B19E3779F9)
    low = np.uint64(len(key).bit_length())  # places below, so that plain sorting keeps their order
    key = np.sort(key >> low << low | np.arange(len(key), dtype="uint64"))
    order = (key & ((np.uint64(1) << low) - np.uint64(1))).astype("int64")
    key >>= low
    same = (key[1:] == key[:-1]).nonzero()[0]
    if not len(same):
        return none
    before = np.full(len(key), -1, "int64")
    before[order[same + 1]] = order[same]
    at, out, size = 0, [], len(x)
    for n, k in zip((spots := (before >= 0).nonzero()[0]).tolist(), before[spots].tolist(), strict=True):
        if n < at:
            continue
        length = 0
        while length < 4096 and n + length < size:
            m = min(32 if not length else 512, size - n - length, 4096 - length)
            differ = x[n + length : n + length + m] != x[k + length : k + length + m]
            stop = int(differ.argmax())
            if differ[stop]:
                length += stop
                break
            length += m
        if length >= 3:
            out.append((n, length, n - k))
            at = n + length
    return tuple(np.array(out, "int64").T) if out else none


def prefixes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """prefix() of many numbers."""
    if not len(x):
        return x, x, x
    which = np.searchsorted(FIRST, x, side="right") - 1
    return which, x - FIRST[which], EXTRA[which]


def put_tokens(out: Writer, x: np.ndarray, width: int, alpha: int = 255) -> bytes:
    """A main picture with references, and with a colour cache if that makes it smaller; one group of codes, one alpha. Ends the file's body."""
    begin, length, back = repeats(x)
    covered = np.zeros(len(x) + 1, "int64")
    covered[begin] = 1  # no two begin or end at one place
    covered[begin + length] -= 1
    literal = (np.cumsum(covered[:-1]) == 0).nonzero()[0]
    colours = x[literal].astype("int64")
    red, green, blue = colours >> 16 & 255, colours >> 8 & 255, colours & 255
    lengths_, near = prefixes(length), np.where(back == 1, 2, np.where(back == width, 1, back + 120))
    cached, first, others, symbol = 0, green, slice(None), 256 + lengths_[0]
    best = bits_of(np.concatenate([green, symbol])) + bits_of(np.concatenate([red, blue]))
    for tried in CACHES:
        slot = ((x * np.uint32(HASH)) >> np.uint32(32 - tried)).astype("uint16")
        order = np.argsort(slot, kind="stable")
        seen, sorted_ = np.zeros(len(x), bool), x[order]
        seen[order[1:]] = sorted_[1:] == sorted_[:-1]  # of one colour, and so of one place
        own = seen[literal]
        if not own.any():
            continue
        index, rest = np.where(own, slot[literal].astype("int64") + 280, green), (~own).nonzero()[0]
        now = bits_of(np.concatenate([index, symbol])) + bits_of(np.concatenate([red[rest], blue[rest]]))
        if now < best:
            best, cached, first, others = now, tried, index, rest
    out.put(1 | cached << 1, 5) if cached else out.put(0, 1)
    out.put(0, 1)  # one group of codes
    red, blue = red[others], blue[others]
    where, extra, n_extra = prefixes(near)
    counts = [np.bincount(np.concatenate([first, symbol]), minlength=280 + ((1 << cached) if cached else 0)), np.bincount(np.concatenate([red, blue]), minlength=256), np.bincount(where, minlength=40)]
    codes = []
    for c in counts:
        if c.max() == c.sum() and not c[:256].any():
            c[0] += 1
        codes.append(huffman(c, DEEPEST))
    out.describe(codes[0], DESCRIBED_BY)
    colours = Writer()
    colours.describe(codes[1], DESCRIBED_BY)
    out.put(colours.value, colours.size)
    out.put(colours.value, colours.size)
    out.put(1 | 1 << 2 | alpha << 3, 11)
    out.describe(codes[2], DESCRIBED_BY)
    words = [codes_of(c) for c in codes]
    width_of = [c.astype("int64") if np.count_nonzero(c) > 1 else np.zeros(len(c), "int64") for c in codes]
    value, size = words[0][first], width_of[0][first]
    for colour in (red, blue):
        so_far = size[others]
        value[others] |= words[1][colour] << so_far.astype("uint64")
        size[others] = so_far + width_of[1][colour]
    v, w = words[0][symbol], width_of[0][symbol]
    for bits, n in ((lengths_[1].astype("uint64"), lengths_[2]), (words[2][where], width_of[2][where]), (extra.astype("uint64"), n_extra)):
        v = v | bits << w.astype("uint64")
        w = w + n
    values, sizes = np.zeros(len(x), "uint64"), np.zeros(len(x), "int64")
    values[literal], sizes[literal], values[begin], sizes[begin] = value, size, v, w
    keep = sizes.nonzero()[0]
    if not len(keep):
        return out.value.to_bytes((out.size + 7) // 8, "little")
    return packed(out, values[keep], sizes[keep])


def relations(c: np.ndarray) -> tuple[int, int, bool]:
    """Of samples c(n, 3): the cross-colour multipliers, in 32nds as bytes, that fit best, of red by green and of blue by green,
    0 where green tells less than a tenth of the other's variance; and whether a pixel tells a tenth of its next one's."""
    apart = c.view("int8").astype("float32")
    apart -= apart.mean(axis=0)
    both = (apart.T @ apart).tolist()
    green = both[1][1]
    by = [min(127, max(-128, round(32 * both[1][k] / green))) & 255 if 10 * both[1][k] ** 2 > green * both[k][k] else 0 for k in (0, 2)]
    return by[0], by[1], 10 * float(np.vdot(apart[1:], apart[:-1])) ** 2 > float(np.vdot(apart, apart)) ** 2


def block_modes(c: np.ndarray, grain: int) -> tuple[np.ndarray, np.ndarray]:
    """The mode of TRIED with the least residuals for each block of samples c(height, width, 3), and the residuals, as samples."""
    height, width = c.shape[:2]
    near = np.zeros((height + 1, width + 1, 3), "uint8")  # black beyond the edges
    near[1:, 1:] = c
    left, top, corner = near[1:, :-1], near[:-1, 1:], near[:-1, :-1]
    told = {1: left, 2: top, 4: corner, 8: ((corner.astype("uint16") + top) >> 1).astype("uint8")}
    rows, columns = np.arange(0, height, 1 << grain), np.arange(0, width, 1 << grain)
    rests = np.stack([c - told[m] for m in TRIED])
    cost = np.minimum(rests, 0 - rests).sum(axis=-1, dtype="uint32")
    best = np.add.reduceat(np.add.reduceat(cost, rows, axis=1), columns, axis=2).argmin(axis=0)
    rest = np.empty_like(c)
    for k in range(len(rows)):
        for m in range(len(columns)):
            here = slice(rows[k], rows[k] + (1 << grain)), slice(columns[m], columns[m] + (1 << grain))
            rest[here] = rests[best[k, m]][here]
    rest[0, 1:], rest[1:, 0], rest[0, 0] = (c[0, 1:] - c[0, :-1]), (c[1:, 0] - c[:-1, 0]), c[0, 0]
    return np.array(TRIED)[best], rest


def coloured(c: np.ndarray, alpha: int = 255) -> np.ndarray:
    """Samples (n, 3) as pixels."""
    c = c.reshape(-1, 3).astype("uint32")
    return c[:, 0] << 16 | c[:, 1] << 8 | c[:, 2] | np.uint32(alpha << 24)


def encode_payload(samples: np.ndarray, width: int, grain: int = 4) -> bytes:
    """A file of 8-bit samples, three a pixel (red, green, blue), all opaque: as it is, with a palette, with cross-colour or
    with predictors, whichever leaves the least entropy; with references and a colour cache. One rule for all lengths."""
    c = samples.reshape(-1, 3)
    x, height = coloured(c), len(c) // width
    out = header(width, height, False)
    changes = (x[1:] != x[:-1]).nonzero()[0]
    n = int(changes[-1]) + 2 if len(changes) else 1  # what comes after is a run, which a reference covers

    def left(own: np.ndarray) -> float:
        return bits_of(own[:n, 1]) + bits_of(own[:n, ::2].reshape(-1))

    sizes, crossed_ = {"as it is": left(c)}, c
    by_red, by_blue, next_ = relations(c[:n])
    if by_red or by_blue:
        green = c[:, 1].view("int8").astype("int32")
        told = [(green * int(np.int8(np.uint8(m))) >> 5).astype("uint8") for m in (by_red, by_blue)]
        crossed_ = np.column_stack([c[:, 0] - told[0], c[:, 1], c[:, 2] - told[1]])
        sizes["cross"] = left(crossed_) + 90
    colours = np.sort(x[:n])
    colours = colours[np.append(True, colours[1:] != colours[:-1])]
    if len(colours) <= 256:
        index = np.searchsorted(colours, x[:n])
        steps = np.diff(channels(colours), axis=0, prepend=0).astype("uint8")
        sizes["palette"] = bits_of(index) + bits_of(steps[:, 2]) + bits_of(steps[:, 1::2].reshape(-1)) + 120
    if next_:
        modes, rest = block_modes(c.reshape(height, width, 3), grain)
        sizes["predictor"] = left(rest.reshape(-1, 3)) + 120 + 2 * modes.size
    how = min(sizes, key=sizes.get)
    if how == "palette":
        out.put(1 | PALETTE << 1, 3)
        out.put(len(colours) - 1, 8)
        put_picture(out, joined(np.diff(channels(colours), axis=0, prepend=0))[None, :], False)
        shift = palette_bits(len(colours))
        index = np.searchsorted(colours, x).reshape(height, width)
        index = np.pad(index, ((0, 0), (0, -width % (1 << shift))))
        width = index.shape[1] >> shift
        index = (index.reshape(height, -1, 1 << shift) << (np.arange(1 << shift) * (8 >> shift))).sum(-1)
        x = (index << 8 | 0xFF000000).astype("uint32").reshape(-1)
    elif how == "cross":
        out.put(1 | CROSS << 1, 3)
        out.put(9 - 2, 3)
        put_picture(out, np.full(((height + 511) >> 9, (width + 511) >> 9), 0xFF000000 | by_blue << 8 | by_red, "uint32"), False, references=True)
        x = coloured(crossed_)
    elif how == "predictor":
        out.put(1 | PREDICTOR << 1, 3)
        out.put(grain - 2, 3)
        put_picture(out, (modes.astype("uint32") << 8) | np.uint32(0xFF000000), False)
        x = coloured(rest, 0)
    out.put(0, 1)
    return framed(put_tokens(out, x, width, 0 if how == "predictor" else 255))
