"""Anchors of byte strings: positions that any two equal 100-byte strings choose alike."""

from __future__ import annotations

import numpy as np

from strideloom.llm.hashing import mixed

#: Length of the strings to find, of the grams that are hashed, and of the gram starts in a string.
LENGTH, GRAM = 100, 32
STARTS = LENGTH - GRAM + 1
#: Bytes from an anchor back to the first string that holds it, and from there to the end of the last.
BEFORE = STARTS - 1
CONTEXT = BEFORE + LENGTH
#: Bytes hashed at once: positions take 20 bits.
SEGMENT = 1 << 19

_rng = np.random.default_rng(20240607)
BYTE = _rng.integers(0, 2**64, 257, np.uint64)  # 256 stands for what is outside the document
STEPS = {1 << k: np.uint64(pow(0x9E3779B97F4A7C15, 1 << k, 1 << 64)) for k in range(6)}
POWERS = (_rng.integers(0, 2**63, CONTEXT, np.uint64) << np.uint64(1)) | np.uint64(1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the GRAM bytes from each position on, by doubling of shorter grams' hashes."""
    h, size = BYTE[data], 1
    while size < GRAM:
        h = h[:-size] * STEPS[size] + h[size:]
        size *= 2
    return mixed(h)


def anchor_positions(data: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of texts that lie one after another, ``doc`` being the text of each byte: position and gram hash.

    Of each string's grams the one of least hash is an anchor, the rightmost of equals.
    """
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(data)
    # the hash above the inverse of the position: one minimum finds both
    low = np.uint64((1 << 20) - 1)
    m = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
    size = 1
    while size * 2 <= STARTS:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    rest = STARTS - size
    m = np.minimum(m[: len(m) - rest], m[rest:])
    inside = doc[: n - LENGTH + 1] == doc[LENGTH - 1 :]
    at = np.unique(low - (m[inside] & low)).astype(np.int64)
    return at, h[at]


def context(data: np.ndarray, low: np.ndarray, high: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the CONTEXT bytes around each anchor, those outside the text from ``low`` to ``high`` told apart."""
    where = at[:, None] + np.arange(-BEFORE, LENGTH)
    out = (where < low[:, None]) | (where >= high[:, None])
    values = data[np.clip(where, 0, len(data) - 1)].astype(np.int64)
    values[out] = 256
    return mixed((BYTE[values] * POWERS).sum(1, dtype=np.uint64))


def anchors(data: np.ndarray, offsets: np.ndarray):
    """Anchors of the texts data[offsets[i]:offsets[i + 1]], in segments: text, position in it, gram hash, context hash."""
    lengths = np.diff(offsets)
    i = 0
    while i < len(lengths):
        j, size = i, 0
        while j < len(lengths) and (j == i or size + lengths[j] <= SEGMENT):
            size += lengths[j]
            j += 1
        lo, hi = int(offsets[i]), int(offsets[j])
        seen = -1
        for a in range(lo, max(lo + 1, hi - LENGTH + 1), SEGMENT):  # a text longer than a segment is cut, with an overlap
            b = min(hi, a + SEGMENT + LENGTH - 1)
            doc = np.searchsorted(offsets, np.arange(a, b), side="right") - 1
            at, h = anchor_positions(data[a:b], doc)
            at = at + a
            h, at = h[at > seen], at[at > seen]  # an overlap's anchors are found twice
            if len(at):
                seen = int(at[-1])
                d = np.searchsorted(offsets, at, side="right") - 1
                yield d, at - offsets[d], h, context(data, offsets[d], offsets[d + 1], at)
        i = j
