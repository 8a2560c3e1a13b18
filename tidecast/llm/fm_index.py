"""A compressed full-text index over words: the FM-index, on a wavelet matrix.

Backward search narrows a range of sorted suffixes word by word, from the end of a pattern
to its start; the size of the range is how often the pattern occurs. All patterns take their
steps together, as arrays.
"""

from __future__ import annotations

import numpy as np


#: Masks of the bits below each bit of a word.
_LOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of the suffixes, ordered by at least their first ``depth`` symbols."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    k = 1
    while k < depth and n and rank.max() + 1 < n:
        after = np.zeros(n, np.int64)
        after[:-k] = rank[k:] + 1
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
        k *= 2
    return np.argsort(rank, kind="stable")


class WaveletMatrix:
    """Counts of symbols before a position, in one packed bit row per bit of the symbols."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.rows, self.zeros = [], []
        for b in range(self.bits - 1, -1, -1):
            bit = (symbols >> b) & 1
            padded = np.zeros((len(bit) // 64 + 1) * 64, np.uint8)
            padded[:len(bit)] = bit
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.cumsum(np.bitwise_count(packed), dtype=np.int64)
            before -= np.bitwise_count(packed)
            self.rows.append((packed, before))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the count of a symbol before a position ends up, with the symbol's own offset."""
        for level, (packed, before) in enumerate(self.rows):
            word = at >> 6
            ones = before.take(word)
            ones += np.bitwise_count(packed.take(word) & _LOW.take(at & 63))
            one = (symbol & (1 << (self.bits - 1 - level))) != 0
            at = np.where(one, ones + self.zeros[level], at - ones)
        return at


class FMIndex:
    """Index of a text of symbols from 1; 0 separates its parts and is in no pattern.

    Patterns may have up to ``depth - 1`` symbols.
    """

    def __init__(self, text: np.ndarray, depth: int):
        self.size, top = len(text), int(text.max(initial=0))
        order = sorted_suffixes(text, depth)
        self.matrix = WaveletMatrix(text[order - 1], top)
        self.ends = np.cumsum(np.bincount(text, minlength=top + 1))
        first = np.concatenate([[0], self.ends])[:-1]
        self.first = first
        symbols = np.arange(top + 1)
        self.base = first - self.matrix.place(symbols, np.zeros(top + 1, np.int64))

    def start(self, symbol: np.ndarray):
        """Ranges of the patterns of one symbol."""
        return self.first[symbol], self.ends[symbol]

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        """Ranges of the patterns with one symbol more in front."""
        both = self.matrix.place(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        return self.base[symbol] + both[:len(lo)], self.base[symbol] + both[len(lo):]


def repeated_windows(index: FMIndex, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray,
                     window: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Matching statistics of patterns that are themselves parts of the indexed text.

    For ends of a pattern from right to left, the longest match that occurs at least twice
    is found; one of ``window`` symbols or more is reported as (pattern, first window,
    number of windows). A match that breaks at a symbol settles all windows across that
    symbol, so the search goes on left of it.
    """
    found = []
    who = np.flatnonzero(lengths >= window)
    end = lengths[who] - 1
    at = end.copy()
    lo, hi = index.start(text[starts[who] + at])
    while len(who):
        twice = hi - lo >= 2
        stop = ~twice | (at == 0)
        left = np.where(twice, at, at + 1)  # the match is left..end
        report = stop & (end - left + 1 >= window)
        if report.any():
            found.append((who[report], left[report], (end - left + 2 - window)[report]))
        again = ~twice
        end = np.where(again, np.minimum(end - 1, at + window - 1), end)
        live = ~(twice & (at == 0)) & ~(again & (end < window - 1))
        at = np.where(again, end, at - 1)
        who, end, at, again = who[live], end[live], at[live], again[live]
        symbol, lo, hi = text[starts[who] + at], lo[live], hi[live]
        more = ~again
        lo[more], hi[more] = index.step(symbol[more], lo[more], hi[more])
        lo[again], hi[again] = index.start(symbol[again])
    return found
