"""A compressed FM-index over word numbers: wavelet matrix of packed bits, backward search in arrays, a sampled suffix array.

Suffixes are sorted by their first `width` words only. Rows that share them then still form one block, in
the right place among the blocks, and that is all a backward search for a pattern of up to `width` words
counts by. The suffix array is not kept: of each block of two suffixes or more one value stays, the least
of the places that the caller has given to their starts.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """Packed bits with a running count every 64, so rank is one lookup and one popcount."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)[:-1]]).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        block = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & below)


def ranks(text: np.ndarray, width: int) -> np.ndarray:
    """For every position the rank of the `width` words that start there, by doubling."""
    n, rank, step = len(text), text.astype(np.int64), 1
    while step < width:
        move = min(step, width - step)
        after = np.zeros(n, np.int64)
        after[: n - move] = rank[move:] + 1
        rank = np.unique(rank * (int(rank.max(initial=0)) + 2) + after, return_inverse=True)[1]
        step += move
    return rank


class FMIndex:
    """text: numbers from 0; 0 ends a record and is never searched for. place: a number for each position of text."""

    def __init__(self, text: np.ndarray, place: np.ndarray, width: int):
        self.size, self.symbols, self.width = len(text), int(text.max(initial=0)) + 1, width
        rank = ranks(text, width)
        suffixes = np.argsort(rank, kind="stable")
        head = np.flatnonzero(np.concatenate([[True], np.diff(rank[suffixes]) != 0])[: self.size])
        repeated = np.diff(np.concatenate([head, [self.size]])) > 1
        marks = np.zeros(self.size + 1, np.uint8)
        marks[head[repeated]] = 1
        self.heads = Bits(marks)
        self.least = np.minimum.reduceat(place[suffixes], head)[repeated] if len(head) else np.empty(0, np.int64)
        current = text[suffixes - 1]
        self.levels, self.zeros = [], []
        for level in range(max(1, (self.symbols - 1).bit_length()) - 1, -1, -1):
            bit = ((current >> level) & 1).astype(np.uint8)
            self.levels.append((level, Bits(bit)))
            self.zeros.append(int(len(bit) - bit.sum()))
            current = np.concatenate([current[bit == 0], current[bit == 1]])
        starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.symbols))])[:-1]
        begin = self._descend(np.arange(self.symbols), np.zeros(self.symbols, np.int64))
        self.shift = starts - begin

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for (level, bits), zeros in zip(self.levels, self.zeros):
            ones = bits.rank(i)
            i = np.where((symbol >> level) & 1, zeros + ones, i - ones)
        return i

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the intervals of symbol + pattern from those of the patterns."""
        both = self._descend(np.concatenate([symbol, symbol]), np.concatenate([low, high])) + np.tile(self.shift[symbol], 2)
        return both[: len(low)], both[len(low) :]

    def matching_statistics(self, stream: np.ndarray, ends: np.ndarray, times: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """For each end in the streamed words: how many words before it, up to `width`, stand `times` times or more in the index, and where the interval of those begins. A streamed text that is in the index itself has repeats from 2 times on."""
        length, begin = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
        left = np.arange(len(ends))
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.size, np.int64)
        for k in range(1, self.width + 1):
            going = ends[left] >= k
            left, low, high = left[going], low[going], high[going]
            symbol = stream[ends[left] - k].astype(np.int64)
            known = (symbol > 0) & (symbol < self.symbols)
            left, low, high = left[known], low[known], high[known]
            low, high = self.extend(symbol[known], low, high)
            enough = high - low >= times
            left, low, high = left[enough], low[enough], high[enough]
            if not len(left):
                break
            length[left], begin[left] = k, low
        return length, begin

    def least_place(self, begin: np.ndarray) -> np.ndarray:
        """The least place of the repeated blocks (matches of the whole width) that begin there."""
        return self.least[self.heads.rank(begin)]
