"""A compressed full-text index over words: suffix array, Burrows-Wheeler transform, wavelet matrix; in numpy.

Only the wavelet matrix and the boundaries that searches need stay after the
build. Searches run over many patterns at once, one word of each in a step.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Bits in 64-bit words, with the number of ones before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.concatenate(([0], np.cumsum(ones)[:-1])).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Symbols by their bits, highest first; at each level zeros go before ones, in order."""

    def __init__(self, symbols: np.ndarray, alphabet: int) -> None:
        self.depth = max(1, int(alphabet - 1).bit_length())
        self.levels: list[tuple[BitVector, int]] = []
        row = symbols.astype(np.int32)
        for level in range(self.depth - 1, -1, -1):
            bit = (row >> level) & 1
            self.levels.append((BitVector(bit.astype(np.uint8)), int(len(row) - bit.sum())))
            row = np.concatenate((row[bit == 0], row[bit == 1]))
        # where each symbol's run begins on the lowest level
        self.begin = self._descend(np.arange(alphabet), np.zeros(alphabet, np.int64))

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, (bits, zeros) in zip(range(self.depth - 1, -1, -1), self.levels, strict=True):
            ones = bits.rank(i)
            i = np.where((symbol >> level) & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before position i."""
        return self._descend(symbol, i) - self.begin[symbol]


class FMIndex:
    """Index of texts of words; ``texts`` is the concatenation of word numbers from 1 on, each text ended by a 0.

    ``window`` fixes the length searches look for: matches are kept at most that long.
    """

    def __init__(self, texts: np.ndarray, window: int) -> None:
        self.size, self.window = len(texts), window
        ends = texts == 0
        self.alphabet = int(texts.max(initial=0)) + 1
        # ends differ from each other, so no comparison passes one
        rank = np.where(ends, np.cumsum(ends) - 1, texts + int(ends.sum())).astype(np.int64)
        _, rank = np.unique(rank, return_inverse=True)
        kept = {1: rank}
        length, order = 1, None
        while True:
            after = np.full(self.size, -1, np.int64)
            after[: self.size - length] = rank[length:]
            key = rank * (self.size + 1) + after + 1
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            new = np.zeros(self.size, np.int64)
            new[order] = np.cumsum(np.concatenate(([0], sorted_key[1:] != sorted_key[:-1])))
            rank, length = new, 2 * length
            kept[length] = rank
            if rank.max(initial=0) == self.size - 1 and length >= window:
                break
        self.order, self.ranks = order, kept
        self.by_length: dict[int, tuple] = {}
        self.short, self.full = self._classes(kept, window - 1), self._classes(kept, window)
        bwt = texts[order - 1]
        self.matrix = WaveletMatrix(bwt, self.alphabet)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(texts, minlength=self.alphabet))))[:-1]

    def _classes(self, kept: dict[int, np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows that agree on ``length`` words: number of each row's class, and begin and end by class."""
        same = np.ones(self.size - 1, bool)
        at = 0
        for part in sorted(kept, reverse=True):
            while length - at >= part:
                shifted = np.full(self.size, -1, np.int64)
                shifted[: self.size - at] = kept[part][at:]
                row = shifted[self.order]
                same &= row[1:] == row[:-1]
                at += part
        begin = np.flatnonzero(np.concatenate(([True], ~same)))
        number = np.zeros(self.size, np.int64)
        number[begin] = 1
        return np.cumsum(number) - 1, begin, np.append(begin[1:], self.size)

    def least(self, values: np.ndarray) -> np.ndarray:
        """For each class of rows that agree on ``window`` words, the least of their positions' values."""
        return np.minimum.reduceat(values[self.order], self.full[1])

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: rows whose text begins with the symbol and then what [low, high) begins with."""
        return self.before[symbol] + self.matrix.rank(symbol, low), self.before[symbol] + self.matrix.rank(symbol, high)

    def shorten(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that agree with row ``low`` on one word less than the window."""
        number = self.short[0][low]
        return self.short[1][number], self.short[2][number]

    def _extend_shorter(self, low: int, matched: int, symbol: int) -> tuple[int, int, int]:
        """Drops words at the match's end until a word can go before it: (low, high, words kept); an unknown word keeps none."""
        if not 0 < symbol < self.alphabet:
            return 0, self.size, -1
        one = np.array([symbol])
        for length in range(matched - 1, 0, -1):
            if length not in self.by_length:
                self.by_length[length] = self._classes(self.ranks, length)
            number, begin, end = self.by_length[length]
            at = number[low]
            new_low, new_high = self.extend(begin[at : at + 1], end[at : at + 1], one)
            if new_low[0] < new_high[0]:
                return int(new_low[0]), int(new_high[0]), length
        new_low, new_high = self.extend(np.zeros(1, np.int64), np.full(1, self.size), one)
        return int(new_low[0]), int(new_high[0]), 0

    def statistics(self, begin: np.ndarray, end: np.ndarray, patterns: np.ndarray) -> np.ndarray:
        """Streams patterns (``patterns[begin:end]``, by word numbers) from their ends.

        Gives for each place of ``patterns`` the class of rows that agree with it
        on ``window`` words, -1 where fewer match.
        """
        out = np.full(len(patterns), -1, np.int64)
        order = np.argsort(begin - end, kind="stable")  # longest first: those that go on are a prefix
        begin, end = begin[order], end[order]
        low, high = np.zeros(len(begin), np.int64), np.full(len(begin), self.size, np.int64)
        matched = np.zeros(len(begin), np.int64)
        sizes = end - begin
        for step in range(int(sizes.max(initial=0))):
            n = int(np.searchsorted(-sizes, -step, side="left"))
            low, high, matched = low[:n], high[:n], matched[:n]
            at = end[:n] - 1 - step
            full = matched == self.window
            if full.any():
                low[full], high[full] = self.shorten(low[full])
                matched[full] -= 1
            symbol = patterns[at]
            known = (symbol > 0) & (symbol < self.alphabet)
            new_low, new_high = self.extend(low, high, np.where(known, symbol, 0))
            good = known & (new_low < new_high)
            for lost in np.flatnonzero(~good).tolist():  # only in texts that the index does not hold
                new_low[lost], new_high[lost], matched[lost] = self._extend_shorter(int(low[lost]), int(matched[lost]), int(symbol[lost]))
            low, high, matched = new_low, new_high, matched + 1
            hit = np.flatnonzero(matched == self.window)
            out[at[hit]] = self.full[0][low[hit]]
        return out
