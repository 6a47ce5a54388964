"""An FM-index over words: suffix order, Burrows-Wheeler text in a wavelet matrix, backward search.

Everything works on arrays, so that one call searches for many patterns.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with rank: 64 bits a word and a running count for each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words)[:-1], out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Symbols as one bit vector for each binary digit, from the highest; each level orders by the digit above it."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for digit in reversed(range(max(1, int(n_symbols - 1).bit_length()))):
            bits = (symbols >> digit & 1).astype(bool)
            self.levels.append((digit, Bits(bits), int(len(bits) - bits.sum())))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        start, end = np.zeros_like(at), at
        for digit, bits, zeros in self.levels:
            one = symbol >> digit & 1 == 1
            s, e = bits.rank(start), bits.rank(end)
            start, end = np.where(one, zeros + s, start - s), np.where(one, zeros + e, end - e)
        return end - start


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Places of the suffixes in order, by doubling; ``text`` must end in a symbol that occurs once and is least."""
    rank = text.astype(np.int64)
    n, size = len(text), 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: max(0, n - size)] = rank[size:]
        key = rank * (rank.max() + 2) + after + 1
        order = np.argsort(key, kind="stable")
        new = np.append(0, key[order][1:] != key[order][:-1]).cumsum()
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        size *= 2


class FMIndex:
    """Index of several sequences of symbols >= 0. Sequences are kept apart by symbols of their own, so that no match
    reaches over an end; ``order`` gives the place in the joined text of each suffix."""

    def __init__(self, sequences: list[np.ndarray]):
        n = len(sequences)
        self.shift = n + 1  # 0 ends the text, 1 … n end the sequences
        parts = [x for i, s in enumerate(sequences) for x in (s + self.shift, np.array([i + 1]))]
        self.text = np.concatenate([*parts, np.array([0])]).astype(np.int64)
        lengths = np.array([len(s) for s in sequences], np.int64)
        self.first = np.cumsum(lengths + 1) - lengths - 1
        self.order = suffix_order(self.text)
        burrows_wheeler = self.text[self.order - 1]
        size = int(self.text.max()) + 1
        self.less = np.append(0, np.cumsum(np.bincount(self.text, minlength=size)))[:-1]
        self.tree = WaveletMatrix(burrows_wheeler, size)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the ranges [low, high) of suffixes, with ``symbol`` before them."""
        return self.less[symbol] + self.tree.rank(symbol, low), self.less[symbol] + self.tree.rank(symbol, high)

    def search_repeated(self, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which, low, high): of the runs of ``length`` symbols from each start on, those that stand at two places
        or more, with the range of suffixes that begin with them. A run is given up once its end stands at one place only."""
        which = np.arange(len(starts))
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.text), np.int64)
        for i in reversed(range(length)):
            low, high = self.extend(self.text[starts[which] + i], low, high)
            more = high - low > 1
            which, low, high = which[more], low[more], high[more]
        return which, low, high
