"""Front-coded sorted runs of suffixes and their merge by a loser tree that knows common prefixes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def common_prefixes(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the one before (0 for the first); rows are padded with zeros."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        first = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
        out[1:] = np.minimum(first, np.minimum(lengths[1:], lengths[:-1]))
    return out


def front_coded(rows: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Sorted rows as shared-prefix lengths, whole lengths, and the rest of each row."""
    shared = common_prefixes(rows, lengths)
    column = np.arange(rows.shape[1])
    rest = (column >= shared[:, None]) & (column < lengths[:, None])
    return shared.astype(np.uint8).tobytes(), lengths.astype(np.uint8).tobytes(), rows[rest].tobytes()


@dataclass
class Run:
    """A sorted run, read from its front-coded form one suffix after another."""

    shared: bytes
    lengths: bytes
    rest: bytes
    at: int = -1
    place: int = 0
    suffix: bytes = b""

    def step(self) -> int | None:
        """Go to the next suffix; the bytes it shares with the one before, or None at the end."""
        self.at += 1
        if self.at == len(self.shared):
            return None
        shared, size = self.shared[self.at], self.lengths[self.at]
        end = self.place + size - shared
        self.suffix = self.suffix[:shared] + self.rest[self.place : end]
        self.place = end
        return shared


def beats(a: bytes, b: bytes, known: int) -> tuple[bool, int]:
    """Whether a goes before b, and their common prefix; the first ``known`` bytes are known to agree."""
    size = min(len(a), len(b))
    if known < size:
        x = int.from_bytes(a[known:size]) ^ int.from_bytes(b[known:size])
        if x:
            known = size - (x.bit_length() + 7) // 8
            return a[known] < b[known], known
    return len(a) <= len(b), size


def merge(runs: list[Run]):
    """Run number, place in the run, and bytes shared with the suffix before, of all suffixes in order.

    Each player of the loser tree keeps the common prefix of its suffix with the last winner. Of two players
    the one with the longer prefix goes first and neither is read; if the prefixes are as long, reading starts behind
    them. So no byte known to agree is compared again.
    """
    n = 1
    while n < len(runs):
        n *= 2
    shared = [r.step() if r is not None else None for r in [*runs, *[None] * (n - len(runs))]]
    # all suffixes share 0 bytes with the empty one, the winner before the first
    shared = [None if s is None else 0 for s in shared]
    suffix = [r.suffix for r in runs]

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's prefix becomes that with the winner."""
        sa, sb = shared[a], shared[b]
        if sb is None:
            return a, b
        if sa is None:
            return b, a
        if sa != sb:
            return (a, b) if sa > sb else (b, a)
        first, same = beats(suffix[a], suffix[b], sa)
        if first:
            shared[b] = same
            return a, b
        shared[a] = same
        return b, a

    losers = [0] * n
    winners = list(range(n))
    level = n
    while level > 1:
        half = level // 2
        nxt = []
        for i in range(half):
            w, losers[half + i] = play(winners[2 * i], winners[2 * i + 1])
            nxt.append(w)
        winners, level = nxt, half
    w = winners[0]
    while shared[w] is not None:
        r = runs[w]
        yield w, r.at, shared[w]
        shared[w] = r.step()
        if shared[w] is not None:
            suffix[w] = r.suffix
        node = (n + w) // 2
        while node:
            w, losers[node] = play(w, losers[node])
            node //= 2
