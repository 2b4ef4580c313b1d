"""FM-index over a sequence of symbols: suffix order, wavelet matrix, samples.

All steps work on whole numpy arrays. Symbols are small non-negative integers;
0 ends the text and must not occur in it.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def suffix_order(text: np.ndarray, bits: int) -> np.ndarray:
    """Starts of all suffixes in order. `text` ends with its only 0.

    Several symbols are packed into the first key; then ranks are doubled for
    those suffixes only that are still tied.
    """
    n = len(text)
    h = 62 // bits
    padded = np.concatenate((text.astype(np.int64), np.zeros(h, np.int64)))
    key = np.zeros(n, np.int64)
    for k in range(h):
        key = key << bits | padded[k : k + n]
    order = np.argsort(key)
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    tied = ~new
    tied[:-1] |= ~new[1:]
    rows = np.flatnonzero(tied)
    while len(rows):
        own = order[rows]
        after = own + h
        key = rank[own] << 32 | np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key)
        own, key = own[by], key[by]
        order[rows] = own
        new = np.ones(len(rows), bool)
        new[1:] = key[1:] != key[:-1]
        rank[own] = np.maximum.accumulate(np.where(new, rows, 0))
        tied = ~new
        tied[:-1] |= ~new[1:]
        rows, h = rows[tied], 2 * h
    return order


class Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate((packed, np.zeros(-len(packed) % 8 + 8, np.uint8))).view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) > 0


@lru_cache(4)
def _reversed(bits: int) -> np.ndarray:
    """All numbers of so many bits, in order of their bits read backwards."""
    x = np.zeros(1 << bits, np.int64)
    for level in range(bits):
        x |= (np.arange(1 << bits) >> level & 1) << bits - 1 - level
    return x


class Wavelet:
    """A wavelet matrix: ranks of symbols in a sequence."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels, self.zeros = bits, [], []
        # the last level's order is that of the symbols' bits read backwards
        order, count = _reversed(bits), np.bincount(symbols, minlength=1 << bits)
        self.base = np.empty(1 << bits, np.int64)
        self.base[order] = np.cumsum(count[order]) - count[order]
        for level in range(bits - 1, -1, -1):
            one = (symbols >> level & 1).astype(bool)
            self.levels.append(Bits(one))
            symbols = np.concatenate((symbols[~one], symbols[one]))
            self.zeros.append(len(one) - int(one.sum()))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = level.rank(i)
            i = np.where(symbol >> (self.bits - 1 - k) & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before place i."""
        return self._down(symbol, i) - self.base[symbol]

    def at(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the symbol at each place, how often it stands before it)."""
        symbol = np.zeros(len(i), np.int64)
        for level, zeros in zip(self.levels, self.zeros, strict=True):
            one, ones = level.get(i), level.rank(i)
            symbol = symbol << 1 | one
            i = np.where(one, zeros + ones, i - ones)
        return symbol, i - self.base[symbol]


class FMIndex:
    def __init__(self, text: np.ndarray, bits: int, every: int = 32):
        """An index of `text`, which must not hold 0; suffixes at every `every`-th place are kept."""
        text = np.concatenate((text, np.zeros(1, text.dtype)))
        self.n = len(text)
        order = suffix_order(text, bits)
        self.wavelet = Wavelet(text[order - 1], bits)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=1 << bits))))
        kept = order % every == 0
        self.kept, self.samples = Bits(kept), order[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of patterns: rows of a matrix, right-aligned."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.flatnonzero(lengths > 0)
        width = patterns.shape[1]
        for k in range(1, width + 1):
            live = live[(lengths[live] >= k) & (lo[live] < hi[live])]
            if not len(live):
                break
            c = patterns[live, width - k]
            both = self.wavelet.rank(np.concatenate((c, c)), np.concatenate((lo[live], hi[live])))
            lo[live], hi[live] = self.first[c] + both[: len(live)], self.first[c] + both[len(live) :]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where in the text the suffixes of the rows begin."""
        out, at, steps = np.zeros(len(rows), np.int64), rows.copy(), 0
        live = np.arange(len(rows))
        while len(live):
            here = at[live]
            done = self.kept.get(here)
            out[live[done]] = self.samples[self.kept.rank(here[done])] + steps
            live, here = live[~done], here[~done]
            symbol, before = self.wavelet.at(here)
            at[live] = self.first[symbol] + before
            steps += 1
        return out
