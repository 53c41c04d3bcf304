"""Weights and dense arithmetic on Arrow batches. Python workers import this module and little else."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

BATCH_CELLS = 1 << 22


@dataclass(frozen=True)
class AdditiveWeights:
    """logit(x) = v . tanh(x W + b); W is (dim, hidden)."""

    w: np.ndarray
    b: np.ndarray
    v: np.ndarray


@dataclass(frozen=True)
class PersonalizedWeights:
    """query(u) = tanh(relu(u W1 + b1) W2 + b2); W1 is (user dim, query dim), W2 is (query dim, dim)."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray


@dataclass(frozen=True)
class SelfAttentionWeights:
    """Multi-head attention; every matrix is (dim, dim) and multiplies from the right."""

    wq: np.ndarray
    wk: np.ndarray
    wv: np.ndarray
    wo: np.ndarray
    heads: int = 16
    biases: dict[str, np.ndarray] = field(default_factory=dict)  # optional bq, bk, bv, bo


def softmax(logits: np.ndarray, times: np.ndarray) -> np.ndarray:
    raised = np.exp(logits - logits.max(axis=-1, keepdims=True)) * times
    return raised / raised.sum(axis=-1, keepdims=True)


def multi_head(x: np.ndarray, times: np.ndarray, weights: SelfAttentionWeights) -> np.ndarray:
    """Multi-head attention for equally long sequences, (batch, items, dim)."""
    batch, n, dim = x.shape
    per_head = dim // weights.heads

    def heads(w: np.ndarray, bias: str) -> np.ndarray:
        projected = x @ w + weights.biases.get(bias, 0.0)
        return projected.reshape(batch, n, weights.heads, per_head).transpose(0, 2, 1, 3)

    q, k, v = heads(weights.wq, "bq"), heads(weights.wk, "bk"), heads(weights.wv, "bv")
    share = softmax(q @ k.transpose(0, 1, 3, 2) / np.sqrt(per_head), times[:, None, None, :])
    joined = (share @ v).transpose(0, 2, 1, 3).reshape(batch, n, dim)
    return joined @ weights.wo + weights.biases.get("bo", 0.0)


def vector_array(rows: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as a list column."""
    n, dim = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * dim, dim), type=pa.int32()), pa.array(rows.reshape(-1)))


def sequences(
    vectors: pa.ListArray, *numbers: pa.ListArray, cells: int = BATCH_CELLS
) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows of a batch grouped by number of items: row numbers, vectors, and each list of numbers.

    A step has at most about ``cells`` numbers, which bounds the memory of a task however large its batches are.
    """
    lengths = np.asarray(vectors.value_lengths())
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    inner = vectors.flatten()
    if not len(inner):
        return
    flat = np.asarray(inner.flatten(), dtype=np.float64).reshape(len(inner), -1)
    lists = [np.asarray(values.flatten(), dtype=np.float64) for values in numbers]
    for n in np.unique(lengths[lengths > 0]):
        same = np.flatnonzero(lengths == n)
        step = max(1, cells // (n * max(flat.shape[1], 16 * n)))
        for rows in np.split(same, range(step, len(same), step)):
            at = starts[rows][:, None] + np.arange(n)[None, :]
            yield rows, flat[at], *[values[at] for values in lists]
