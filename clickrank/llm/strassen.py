"""Strassen's matrix product of int64 matrices of any shape, with zero padding and exact integer additions."""

from __future__ import annotations

import numpy as np

from clickrank.llm.vectors import product

CUTOFF = 16  # a side this short is multiplied directly


def _even(x: np.ndarray) -> np.ndarray:
    rows, columns = x.shape
    return np.pad(x, ((0, rows % 2), (0, columns % 2))) if rows % 2 or columns % 2 else x


def _quarters(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    r, c = x.shape[0] // 2, x.shape[1] // 2
    return x[:r, :c], x[:r, c:], x[r:, :c], x[r:, c:]


def multiply(a: np.ndarray, b: np.ndarray, cutoff: int = CUTOFF) -> np.ndarray:
    """``a @ b`` by seven products of quarters, recursively; sides of odd length are filled up with a zero.

    All additions are of 64-bit integers. Sums that leave 64 bits on the way come back modulo 2^64, so the result is
    exact whenever it fits. Quarters are multiplied in doubles where that is exact, else in int64.
    """
    rows, columns = a.shape[0], b.shape[1]
    if min(rows, a.shape[1], columns) <= cutoff:
        return product(a, b)
    a11, a12, a21, a22 = _quarters(_even(a))
    b11, b12, b21, b22 = _quarters(_even(b))
    m1 = multiply(a11 + a22, b11 + b22, cutoff)
    m2 = multiply(a21 + a22, b11, cutoff)
    m3 = multiply(a11, b12 - b22, cutoff)
    m4 = multiply(a22, b21 - b11, cutoff)
    m5 = multiply(a11 + a12, b22, cutoff)
    m6 = multiply(a21 - a11, b11 + b12, cutoff)
    m7 = multiply(a12 - a22, b21 + b22, cutoff)
    r, c = m1.shape
    out = np.empty((2 * r, 2 * c), np.int64)
    out[:r, :c] = m1 + m4 - m5 + m7
    out[:r, c:] = m3 + m5
    out[r:, :c] = m2 + m4
    out[r:, c:] = m1 - m2 + m3 + m6
    return out[:rows, :columns]
