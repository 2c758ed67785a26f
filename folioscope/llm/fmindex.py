"""Full-text index of a sequence of symbols: wavelet-matrix ranks over the Burrows-Wheeler transform, backward search,
and occurrences by sampled suffix positions.

Symbol 0 is a break: no phrase holds it, and every break is a symbol of its own that sorts by its place. So a suffix is
told apart from all others at its first break at the latest.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in their order. The last symbol must be a break.

    Ranks by the first w symbols are packed, several to an integer, into ranks by a multiple of w; only suffixes that
    still share their rank with another are sorted again.
    """
    n = len(symbols)
    breaks = symbols == 0
    rank = np.where(breaks, np.cumsum(breaks) - 1, symbols + int(breaks.sum()))
    rows, order, width = np.arange(n), np.arange(n), 1
    top = int(rank.max())
    while len(rows):
        bits = max(1, top.bit_length())
        packed = max(2, 63 // bits)
        places = order[rows]
        key = rank[places]
        for j in range(1, packed):
            key = (key << bits) | rank[np.minimum(places + j * width, n - 1)]
        sorting = np.argsort(key)
        places, key = places[sorting], key[sorting]
        order[rows] = places
        first = np.concatenate(([True], key[1:] != key[:-1]))
        rank[places] = rows[np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))]
        rows = rows[~(first & np.concatenate((first[1:], [True])))]
        width, top = width * packed, n - 1
    return order


class Bits:
    """Bits in 64-bit words with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        padded = np.zeros((len(bits) // 64 + 1) * 8, dtype=np.uint8)
        padded[: len(packed)] = packed
        self.words = padded.view("<u8")
        self.upto = np.zeros(len(self.words) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.upto[1:])

    def ones(self, places: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = places >> 6
        mask = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
        return self.upto[word] + np.bitwise_count(self.words[word] & mask)

    def at(self, places: np.ndarray) -> np.ndarray:
        return ((self.words[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class Wavelet:
    """A wavelet matrix: one level of bits per binary digit of the symbols, each level sorted by the digit above."""

    def __init__(self, symbols: np.ndarray, depth: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for digit in range(depth - 1, -1, -1):
            ones = (symbols >> digit) & 1 == 1
            zeros = symbols[~ones]
            self.levels.append((digit, Bits(ones), len(zeros)))
            symbols = np.concatenate((zeros, symbols[ones]))

    def down(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Where a place ends up below all levels on the way of a symbol: the symbol's rank, but for a constant."""
        for digit, bits, zeros in self.levels:
            ones = bits.ones(places)
            places = np.where((symbols >> digit) & 1 == 1, zeros + ones, places - ones)
        return places

    def read(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at the given places, and where these end up on the way of their own symbols."""
        symbols = np.zeros(len(places), dtype=np.int64)
        for _, bits, zeros in self.levels:
            one, ones = bits.at(places), bits.ones(places)
            symbols = (symbols << 1) | one
            places = np.where(one, zeros + ones, places - ones)
        return symbols, places


class Index:
    """Counts and locates phrases in a sequence of symbols below `size` that ends with a break."""

    def __init__(self, symbols: np.ndarray, size: int, sampling: int = 8):
        order = suffix_order(symbols)
        before = symbols[order - 1]
        self.first = np.zeros(size + 1, dtype=np.int64)
        np.cumsum(np.bincount(symbols, minlength=size), out=self.first[1:])
        self.tree = Wavelet(before, max(1, (size - 1).bit_length()))
        every = np.arange(size)
        self.shift = self.first[:-1] - self.tree.down(every, np.zeros(size, dtype=np.int64))
        # Where a break stands before a suffix, no step leads further back.
        sampled = (order % sampling == 0) | (before == 0)
        self.sampled, self.positions = Bits(sampled), order[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of suffixes that start with each phrase, from and to. Phrases are given backwards, one a row, with
        anything behind their lengths."""
        low, high = self.first[phrases[:, 0]], self.first[phrases[:, 0] + 1]
        for step in range(1, phrases.shape[1]):
            on = np.flatnonzero((lengths > step) & (low < high))
            if not len(on):
                break
            symbols = phrases[on, step]
            low[on] = self.tree.down(symbols, low[on]) + self.shift[symbols]
            high[on] = self.tree.down(symbols, high[on]) + self.shift[symbols]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of the given rows start."""
        found, steps = np.zeros(len(rows), dtype=np.int64), 0
        on = np.arange(len(rows))
        while len(on):
            known = self.sampled.at(rows)
            found[on[known]] = self.positions[self.sampled.ones(rows[known])] + steps
            on, rows = on[~known], rows[~known]
            symbols, below = self.tree.read(rows)
            rows, steps = below + self.shift[symbols], steps + 1
        return found
