"""Words, hashes and shingles of a batch of UTF-8 texts as NumPy arrays.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``. All separators are ASCII, so work on bytes equals work on code
points. Null texts have no bytes. Nothing here is a Python object per word; memory is a small multiple of the bytes
of one piece, and pieces hold about ``PIECE`` bytes or one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_random = np.random.default_rng(20240229)
_BYTE = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_BYTE = _BYTE.copy()
_LOWER_BYTE[65:91] = _BYTE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD1342543DE82EF95)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_UP = _powers(_BASE, PIECE + 1)
_DOWN = _powers(_INVERSE, PIECE + 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that all bits of a hash can be used."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of about ``size`` bytes; a longer text is one piece."""
    data, offsets = text_bytes(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row and the total): words never reach over rows."""
    inside = ~_SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    before[cut] = False
    after[cut - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of words; ``lower`` folds A-Z only."""
    table = _LOWER_BYTE if lower else _BYTE
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        low = starts[first]
        end = int(np.searchsorted(ends, low + PIECE, "right"))
        if end <= first:  # one word longer than a piece
            raw = data[low : ends[first]].tobytes()
            digest = hashlib.blake2b(raw.lower() if lower else raw, digest_size=8).digest()
            out[first] = np.frombuffer(digest, np.uint64)[0]
            first += 1
            continue
        part = data[low : ends[end - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(table[part] * _UP[: len(part)], out=sums[1:])
        s, e = starts[first:end] - low, ends[first:end] - low
        out[first:end] = (sums[e] - sums[s]) * _DOWN[s] + (e - s).astype(np.uint64)
        first = end
    return mixed(out)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive words; the caller leaves out runs over the end of a row."""
    count = max(0, len(words) - n + 1)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = out * _STEP + words[i : i + count]
    return mixed(out)


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` within each row given by ``offsets``."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word ``n``-grams of one document; a shorter one is one shingle, no word none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(gram_hashes(words, n if len(words) >= n else len(words)))
