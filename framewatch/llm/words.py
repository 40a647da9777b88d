"""Words ``[^\\x20\\x09-\\x0D]+`` of a column of texts as 64-bit hashes, a slice at a time, in numpy.

The hash is a polynomial in a random table of byte values modulo 2**64, mixed at
the end. It depends on nothing but the word's bytes, so it is the same in every
task; UTF-8 never holds a separator byte inside a character, so bytes suffice.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPAN = 1 << 20
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64; kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, _SPAN), base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass
class Words:
    """Words of a slice: their hashes, byte places in ``data``, and where each text's words begin (one more at the end)."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    data: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.offsets))


def buffer(column: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and the place where each begins."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(column: pa.LargeStringArray, lower: bool = False) -> Words:
    data, places = buffer(column)
    if lower:
        data = data + ((data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))
    inside = (data != 0x20) & (data - np.uint8(9) > 4)
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        bounds = places[(places > 0) & (places < len(data))]
        first[bounds] |= inside[bounds]
        last[bounds - 1] |= inside[bounds - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(hash_spans(data, starts, ends), starts, ends, np.searchsorted(starts, places), data)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each data[start:end]; starts ascend. Works through the data in pieces of bounded size."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SPAN, side="right")))
        low, high = int(starts[i]), int(ends[j - 1])
        v = _BYTES[data[low:high]] * powers(_BASE, high - low)
        total = np.cumsum(v, dtype=np.uint64)
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (total[e - 1] - total[s] + v[s]) * powers(_INVERSE, high - low)[s]
        i = j
    return mix(out ^ (ends - starts).astype(np.uint64))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n consecutive hashes."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        total = total * np.uint64(_BASE) + hashes[i : len(hashes) - n + 1 + i]
    return mix(total)
