"""A compressed FM-index over integer sequences: a wavelet matrix of the Burrows-Wheeler transform, searched backwards.

The suffixes are sorted by their first 16 symbols only, by doubling. That is enough for patterns of up to 16 symbols,
because a pattern's interval depends on how suffixes compare with the pattern and not on the order inside the interval.
All searches of a batch step together, as NumPy arrays.
"""

from __future__ import annotations

import numpy as np

DEPTH = 16
_ONE = np.uint64(1)


class BitVector:
    """Packed bits with a running count per 64-bit word."""

    def __init__(self, bits: np.ndarray):
        packed = np.zeros((len(bits) + 64) // 64 * 8, np.uint8)
        raw = np.packbits(bits, bitorder="little")
        packed[: len(raw)] = raw
        self.words = packed.view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        word = at >> 6
        mask = (_ONE << (at & 63).astype(np.uint64)) - _ONE
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels: list[tuple[int, BitVector, int]] = []
        for shift in range(levels - 1, -1, -1):
            bits = (symbols >> shift) & 1
            self.levels.append((shift, BitVector(bits.astype(np.uint8)), int(len(bits) - bits.sum())))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Place in the bottom level of the prefix ``[0, at)`` seen from each symbol."""
        for shift, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where((symbols >> shift) & 1, zeros + ones, at - ones)
        return at


class FMIndex:
    """Index of sequences of non-negative integers, each ended by a symbol that no pattern holds."""

    def __init__(self, sequences: np.ndarray, lengths: np.ndarray):
        self.alphabet, inverse = np.unique(sequences, return_inverse=True)
        n = len(sequences) + len(lengths)
        ends = np.cumsum(lengths + 1) - 1
        self.text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        self.text[inside] = inverse + 1
        self.starts = ends - lengths
        rank, width = self.text.copy(), 1
        while width < DEPTH:
            following = np.zeros(n, np.int64)
            following[:-width] = rank[width:] + 1 if width < n else 0
            _, rank = np.unique(rank * (n + 2) + following, return_inverse=True)
            width *= 2
        self.suffixes = np.argsort(rank, kind="stable")
        transform = self.text[self.suffixes - 1]
        self.tree = WaveletMatrix(transform, max(1, int(len(self.alphabet)).bit_length()))
        self.counts = np.searchsorted(self.text[self.suffixes], np.arange(len(self.alphabet) + 2))
        symbols = np.arange(len(self.alphabet) + 2)
        self.zero = self.tree.descend(symbols, np.zeros(len(symbols), np.int64))

    def encode(self, values: np.ndarray) -> np.ndarray:
        """Symbols of values; -1 where the index does not have one."""
        at = np.minimum(np.searchsorted(self.alphabet, values), max(0, len(self.alphabet) - 1))
        found = self.alphabet[at] == values if len(self.alphabet) else np.zeros(len(values), bool)
        return np.where(found, at + 1, -1)

    def matching(self, symbols: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics, capped: for each end (exclusive) the longest match ending there of at most ``most``
        symbols, and its interval of suffixes. ``symbols`` must hold an unknown one (-1) before each sequence's start."""
        lengths = np.zeros(len(ends), np.int64)
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), len(self.text), np.int64)
        alive = np.arange(len(ends))
        for step in range(1, most + 1):
            symbol = symbols[ends[alive] - step]
            known = symbol >= 0
            alive, symbol = alive[known], symbol[known]
            base = self.counts[symbol] - self.zero[symbol]
            a = base + self.tree.descend(symbol, low[alive])
            b = base + self.tree.descend(symbol, high[alive])
            going = b > a
            alive = alive[going]
            low[alive], high[alive] = a[going], b[going]
            lengths[alive] = step
            if not len(alive):
                break
        return lengths, low, high

    def minima(self, values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least of ``values`` (per text position) over each interval; intervals are equal or disjoint."""
        firsts, back = np.unique(low, return_inverse=True)
        lasts = np.zeros(len(firsts), np.int64)
        lasts[back] = high
        edges = np.stack([firsts, lasts], axis=1).ravel()
        padded = np.append(values[self.suffixes], np.iinfo(np.int64).max)
        return np.minimum.reduceat(padded, edges)[::2][back] if len(edges) else np.zeros(0, np.int64)
