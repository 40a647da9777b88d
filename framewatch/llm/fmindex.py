"""An FM-index over sequences of integers, in numpy: wavelet matrix, backward search for many patterns at once."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Bit vectors by level, most significant bit first; a level takes a bit per symbol and 8 bytes per 64 for counts."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.n, self.bits = len(symbols), max(1, int(sigma - 1).bit_length())
        self.words: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.zeros: list[int] = []
        now = symbols.astype(np.int32)
        for level in range(self.bits - 1, -1, -1):
            bit = (now >> level) & 1
            packed = np.zeros((self.n // 64 + 1) * 8, np.uint8)
            raw = np.packbits(bit.astype(bool), bitorder="little")
            packed[: len(raw)] = raw
            words = packed.view(np.uint64)
            counts = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=counts[1:])
            self.words.append(words)
            self.counts.append(counts)
            self.zeros.append(self.n - int(counts[-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position ``at`` of the sequence falls on the lowest level along ``symbol``."""
        for level in range(self.bits):
            word = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[level][word] + np.bitwise_count(self.words[level][word] & mask)
            one = (symbol >> (self.bits - 1 - level)) & 1
            at = np.where(one == 1, self.zeros[level] + ones, at - ones)
        return at


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by the ``depth`` symbols from there, at least (prefix doubling); past the end counts as least."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    done = 1
    while True:
        after = np.zeros_like(rank)
        if done < len(rank):
            after[:-done] = rank[done:]
        key = rank * (rank.max(initial=0) + 1) + after
        order = np.argsort(key)
        done *= 2
        if done >= depth:
            return order
        step = np.ones(len(key), np.int64)
        step[1:] = key[order][1:] != key[order][:-1]
        rank[order] = np.cumsum(step)
        if rank.max(initial=0) == len(rank):
            return order


class FMIndex:
    """Index of sequences laid end to end, a 0 after each; their symbols are 1 and up. Patterns may have up to ``depth`` symbols."""

    def __init__(self, text: np.ndarray, sigma: int, depth: int):
        self.order = suffix_order(text, depth + 1)
        self.first = np.zeros(sigma + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=sigma), out=self.first[1:])
        self.tree = WaveletMatrix(text[self.order - 1], sigma)
        symbols = np.arange(sigma)
        self.base = self.first[:-1] - self.tree.descend(symbols, np.zeros(sigma, np.int64))

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the rows of ``symbol`` before what rows low..high begin with."""
        both = self.tree.descend(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        base = self.base[symbol]
        return both[: len(symbol)] + base, both[len(symbol) :] + base

    def statistics(self, text: np.ndarray, ends: np.ndarray, longest: int, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics: for each place in ``ends`` (exclusive), how many symbols up to there (``longest`` at most)
        occur in the index at ``least`` places, and the interval of rows of that match.
        """
        n = len(ends)
        low, high = np.zeros(n, np.int64), np.full(n, len(self.order), np.int64)
        length = np.zeros(n, np.int64)
        active = np.arange(n)
        for i in range(longest):
            active = active[ends[active] > i]
            symbol = text[ends[active] - 1 - i]
            active, symbol = active[symbol > 0], symbol[symbol > 0]
            if not len(active):
                break
            a, b = self.step(symbol, low[active], high[active])
            good = b - a >= least
            active = active[good]
            low[active], high[active] = a[good], b[good]
            length[active] += 1
        return length, low, high
