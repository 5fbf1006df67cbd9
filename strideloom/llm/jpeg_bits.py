"""Entropy coding of progressive JPEG scans over numpy arrays: tokens of many restart intervals are packed, and decoded, side by side."""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Longest Huffman code, and the symbols of 16 zeros and of a block's end.
LONGEST, ZRL, EOB = 16, 0xF0, 0x00


@dataclass(frozen=True)
class Huffman:
    """counts: codes of each length from 1 to 16; symbols: in the order of their codes."""

    counts: tuple[int, ...]
    symbols: tuple[int, ...]

    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """Code and length by symbol."""
        code, size, at, i = np.zeros(256, np.uint64), np.zeros(256, np.int64), 0, 0
        for length, n in enumerate(self.counts, 1):
            for _ in range(n):
                code[self.symbols[i]], size[self.symbols[i]] = at, length
                at, i = at + 1, i + 1
            at *= 2
        return code, size

    def lookup(self) -> np.ndarray:
        """length * 256 + symbol by the next 16 bits; 0 where no code starts so."""
        out, at, i = np.zeros(1 << LONGEST, np.uint16), 0, 0
        for length, n in enumerate(self.counts, 1):
            for _ in range(n):
                wide = 1 << (LONGEST - length)
                out[at : at + wide] = length << 8 | self.symbols[i]
                at, i = at + wide, i + 1
        return out


def huffman(weights: dict[int, float]) -> Huffman:
    """The code for symbols of these weights, of 16 bits at most and without the code of ones alone, which the format forbids."""
    while True:
        heap = [(w, s, {s: 0}) for s, w in weights.items()] + [(min(weights.values()) / 2, 256, {256: 0})]
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), {s: n + 1 for x in (a[2], b[2]) for s, n in x.items()}))
        sizes = heap[0][2]
        if max(sizes.values()) <= LONGEST:
            break
        least = min(weights.values())
        weights = {s: w + least for s, w in weights.items()}
    del sizes[256]
    order = sorted(sizes, key=lambda s: (sizes[s], s))
    return Huffman(tuple(sum(n == length for n in sizes.values()) for length in range(1, LONGEST + 1)), tuple(order))


def dc_weights(peak: int = 5) -> dict[int, float]:
    return {c: 2.0 ** -abs(c - peak) for c in range(12)}


def first_weights(peak: int) -> dict[int, float]:
    """Of a first pass over coefficients most of which have ``peak`` bits."""
    runs = {r << 4 | s: 2.0 ** -min(12, 2 * abs(s - peak) + 3 * r) for r in range(16) for s in range(1, 11)}
    return runs | {ZRL: 2.0**-10} | {r << 4: 2.0 ** -min(12, 5 + 2 * r) for r in range(15)}


def refining_weights() -> dict[int, float]:
    return {r << 4 | 1: 2.0 ** -(3 + min(r, 9)) for r in range(16)} | {ZRL: 2.0**-12} | {r << 4: 2.0 ** -min(12, 2 * r) for r in range(15)}


@lru_cache(64)
def codes(table: Huffman) -> tuple[np.ndarray, np.ndarray]:
    return table.codes()


@lru_cache(64)
def lookup(table: Huffman) -> np.ndarray:
    return table.lookup()


def bit_length(x: np.ndarray) -> np.ndarray:
    """Of each non-negative integer under 2^52."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def signed_bits(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The format's ``size`` bits of v: v itself, or of a negative one v - 1."""
    return (np.where(v < 0, v - 1, v) & ((1 << size) - 1)).astype(np.uint64)


def packed(interval: np.ndarray, code: np.ndarray, size: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of tokens (in order of their restart interval) and the end of each interval's bytes.

    Each interval is filled up with ones and stuffed. ``marks`` has the number, from 0, of the restart marker that follows it, or -1.
    """
    n = len(marks)
    bits = np.bincount(interval, size, n).astype(np.int64)
    length = (bits + 7) // 8
    start = np.cumsum(length) - length
    before = np.cumsum(size) - size
    at = before - (np.cumsum(bits) - bits)[interval] + 8 * start[interval]
    words = int(start[-1] + length[-1]) // 4 + 3
    room = code << (np.uint64(64) - (at & 31).astype(np.uint64) - size.astype(np.uint64))
    high, low = (room >> np.uint64(32)).astype(np.float64), (room & np.uint64(0xFFFFFFFF)).astype(np.float64)
    # tokens do not overlap, so sums under 2^32 are exact
    word = np.bincount(at >> 5, high, words) + np.bincount((at >> 5) + 1, low, words)
    raw = word.astype(np.uint64).astype(">u4").view(np.uint8)[: int(start[-1] + length[-1])].copy()
    ends = start + length
    full = ends[length > 0] - 1
    raw[full] |= ((1 << (8 * length - bits)) - 1)[length > 0].astype(np.uint8)
    stuffed = raw == 0xFF
    extra = np.where(marks >= 0, 2, 0)
    shift = np.cumsum(stuffed) - stuffed
    own = np.repeat(np.cumsum(extra) - extra, length)
    place = np.arange(len(raw)) + shift + own
    out = np.zeros(len(raw) + int(stuffed.sum()) + int(extra.sum()), np.uint8)
    out[place] = raw
    through = np.concatenate([[0], np.cumsum(stuffed)])[ends]
    closed = ends + through + np.cumsum(extra)
    k = np.flatnonzero(marks >= 0)
    out[closed[k] - 2], out[closed[k] - 1] = 0xFF, 0xD0 + marks[k] % 8
    return out, closed


class Lanes:
    """Restart intervals of entropy-coded data, each at its own bit."""

    def __init__(self, scans: list[bytes]):
        """One interval a restart marker, or one for each scan; ``first`` is the first interval of each scan."""
        whole = np.frombuffer(b"".join(scans), np.uint8)
        sizes = np.array([len(s) for s in scans], np.int64)
        begin = np.cumsum(sizes) - sizes
        after = np.append(whole[1:], np.uint8(0))
        ends_scan = np.zeros(len(whole), bool)
        ends_scan[(begin + sizes - 1)[sizes > 0]] = True
        ff = (whole == 0xFF) & ~ends_scan
        marker = ff & (after >= 0xD0) & (after <= 0xD7)
        keep = ~marker
        keep[1:] &= ~marker[:-1] & ~(ff[:-1] & (whole[1:] == 0))
        kept = np.concatenate([[0], np.cumsum(keep)])
        starts = np.sort(np.concatenate([begin, np.flatnonzero(marker) + 2]), kind="stable")
        self.first = np.searchsorted(starts, begin)
        self.bit = 8 * kept[starts]
        data = np.concatenate([whole[keep], np.full(16 + -int(keep.sum()) % 4, 0xFF, np.uint8)])
        word = data.view(">u4").astype(np.uint64)
        self.words = word[:-1] << np.uint64(32) | word[1:]

    def window(self, bit: np.ndarray) -> np.ndarray:
        """64 bits from ``bit`` on, of which 32 at least are there."""
        return self.words[bit >> 5] << (bit & 31).astype(np.uint64)


def taken(window: np.ndarray, skip: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n bits after the first ``skip``; n may be 0."""
    return ((window << skip.astype(np.uint64)) >> np.uint64(1) >> (63 - n).astype(np.uint64)).astype(np.int64)


def extended(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The value of the format's ``size`` bits."""
    return np.where(bits < (1 << np.maximum(size - 1, 0)), bits - (1 << size) + 1, bits)


def decode_dc(lanes: Lanes, tables: np.ndarray, book: np.ndarray, rows: np.ndarray, start: np.ndarray, end: np.ndarray, parts: np.ndarray, low: int, coefs: np.ndarray) -> None:
    """First pass over DC: rows[start:end] are the blocks of each interval, ``parts`` their component, ``tables`` the lookup of each block in ``book``."""
    bit, at, to = lanes.bit.copy(), start.copy(), end
    before = np.zeros((len(bit), 4), np.int64)
    lane = np.flatnonzero(at < to)
    while len(lane):
        w = lanes.window(bit[lane])
        here = at[lane]
        hit = book[(tables[here] << 16) + (w >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        size, length = hit & 255, hit >> 8
        before[lane, parts[here]] += extended(taken(w, length, size), size)
        coefs[rows[here], 0] = before[lane, parts[here]] << low
        bit[lane] += size + length
        at[lane] += 1
        lane = lane[at[lane] < to[lane]]


def refine_dc(lanes: Lanes, rows: np.ndarray, start: np.ndarray, end: np.ndarray, low: int, coefs: np.ndarray) -> None:
    """One more bit of each block's DC."""
    n = end - start
    own = np.repeat(np.arange(len(n)), n)
    bit = lanes.bit[own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    blocks = rows[np.repeat(start, n) + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)]
    coefs[blocks, 0] |= ((lanes.window(bit) >> np.uint64(63)).astype(np.int16) << low).astype(coefs.dtype)


def decode_ac(lanes: Lanes, tables: np.ndarray, book: np.ndarray, rows: np.ndarray, start: np.ndarray, end: np.ndarray, band: tuple[int, int], low: int, coefs: np.ndarray) -> None:
    """First pass over a band: one symbol of each interval at a time. ``tables`` has the lookup of each interval."""
    first, last = band
    flat = coefs.reshape(-1)
    live = np.flatnonzero(start < end)
    bit, at, to, table = lanes.bit[live], start[live].copy(), end[live], tables[live] << 16
    k = np.full(len(live), first)
    while len(live):
        w = lanes.window(bit)
        hit = book[table + (w >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        length, run, size = hit >> 8, (hit >> 4) & 15, hit & 15
        value = size > 0
        more = np.where(value, size, np.where(run < 15, run, 0))
        bits = taken(w, length, more)
        bit = bit + length + more
        k = k + np.where(value, run, 0)
        flat[(rows[at] * 64 + k)[value]] = (extended(bits, size) << low)[value]
        stop = ~value & (run < 15)
        k = np.where(stop, last + 1, k + np.where(value, 1, 16))
        over = k > last
        at = at + np.where(over, np.where(stop, (1 << run) + bits, 1), 0)
        k = np.where(over, first, k)
        left = at < to
        if not left.all():
            live, bit, at, to, table, k = (x[left] for x in (live, bit, at, to, table, k))


def refine_ac(lanes: Lanes, tables: np.ndarray, book: np.ndarray, rows: np.ndarray, start: np.ndarray, end: np.ndarray, band: tuple[int, int], low: int, coefs: np.ndarray) -> None:
    """One more bit of a band: each interval reads a symbol, or passes one coefficient, at a time."""
    first, last = band
    flat = coefs.reshape(-1)
    live = np.flatnonzero(start < end)
    bit, at, to, table = lanes.bit[live], start[live].copy(), end[live], tables[live] << 16
    k, run, new, blocks = np.full(len(live), first), np.full(len(live), -1), np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
    while len(live):
        w = lanes.window(bit)
        asks = (run < 0) & (blocks == 0)
        hit = book[table + (w >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        length, r, size = hit >> 8, (hit >> 4) & 15, hit & 15
        stop = asks & (size == 0) & (r < 15)
        more = np.where(size > 0, 1, np.where(stop, r, 0))
        bits = taken(w, length, more)
        run = np.where(asks & ~stop, r, run)
        new = np.where(asks, np.where(size > 0, np.where(bits > 0, 1, -1) << low, 0), new)
        blocks = np.where(stop, (1 << r) + bits, blocks)
        # intervals that have read no symbol pass a coefficient
        place = rows[at] * 64 + k
        held = flat[place].astype(np.int64)
        passes = ~asks
        known = passes & (held != 0)
        grow = known & ((w >> np.uint64(63)) > 0) & (np.abs(held) >> low & 1 == 0)
        flat[place[grow]] = (held + np.where(held > 0, 1 << low, -(1 << low)))[grow]
        free = passes & ~known & (blocks == 0)
        hits = free & (run == 0)
        flat[place[hits & (new != 0)]] = new[hits & (new != 0)]
        run = np.where(free, run - 1, run)
        bit = bit + np.where(asks, length + more, known)
        k = k + passes
        over = k > last
        at = at + over
        blocks = np.where(over & (blocks > 0), blocks - 1, blocks)
        run = np.where(over, -1, run)
        k = np.where(over, first, k)
        left = at < to
        if not left.all():
            live, bit, at, to, table, k, run, new, blocks = (x[left] for x in (live, bit, at, to, table, k, run, new, blocks))
