"""Integer vectors of a table in shards, exact products of them, and mergeable heaps of the best rows.

A row takes part when its id is there and its vector is neither null nor holds a null, NaN or infinite component; a
component x becomes ``floor(scale * x)``. Vectors of different lengths count as filled up with zeros. A repeated row is
one more row. Scores are exact in 64 bits; vectors whose products might not fit raise ``OverflowError``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickrank.session import stage

SHARD_ROWS = 65_536  # rows of a shard at most, about; all of them are in the memory of one task
PART_ROWS = 65_536   # queries that are searched in a shard at once, about; shards are copied once per part
EXACT = 1 << 53      # whole numbers up to here are exact as doubles


def usable_rows(df: DataFrame, id_col: str, vec_col: str, **carried) -> DataFrame:
    """``(_row, _id, _vec, carried...)`` of the rows that take part, written once so that ``_row`` stays the same."""
    vec = F.col(vec_col)
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    named = [F.col(id_col).cast("long").alias("_id"), vec.alias("_vec"), *[c.alias(n) for n, c in carried.items()]]
    found = df.where(F.col(id_col).isNotNull() & vec.isNotNull() & finite).select(*named)
    return stage(found.select(F.monotonically_increasing_id().alias("_row"), "*"), "vectors")


def shape(rows: DataFrame) -> tuple[int, int]:
    """(rows, longest vector)."""
    n, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("_vec"))).first()
    return n, dim or 0


def shard_count(rows: DataFrame, n: int, shard_rows: int = SHARD_ROWS) -> int:
    """Shards of ``shard_rows`` rows at most; a small table is dealt to all cores."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-n // shard_rows), min(cores, n // 2048))


def dealt(rows: DataFrame, count: int, name: str) -> DataFrame:
    """``name``: one of ``count`` equal parts, by the row and not by what it holds, so that copies are spread."""
    return rows.withColumn(name, F.pmod(F.xxhash64("_row"), F.lit(count)).cast("int"))


def copied(rows: DataFrame, count: int, name: str) -> DataFrame:
    return rows.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(count - 1))))


def integers(column: pa.ChunkedArray | pa.Array, scale: float, dim: int) -> np.ndarray:
    """Rows of ``dim`` whole numbers, ``floor(scale * x)`` of every component."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten()).astype(np.float64)
    lengths = np.asarray(column.value_lengths()).astype(np.int64)
    scaled = np.floor(scale * flat)
    if len(scaled) and np.abs(scaled).max() >= 2.0**62:
        raise OverflowError("a component does not fit in 64 bits")
    if (lengths == dim).all():
        return scaled.astype(np.int64).reshape(len(lengths), dim)
    out = np.zeros((len(lengths), dim), np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = scaled
    return out


def largest(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


def require_fit(a: np.ndarray, b: np.ndarray, growth: int = 1) -> None:
    if largest(a) * largest(b) * a.shape[1] * growth >= 1 << 63:
        raise OverflowError("a score may not fit in 64 bits")


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` of int64 matrices, exact: in doubles where every sum is below 2^53, else in int64."""
    if largest(a) * largest(b) * a.shape[1] < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


class Heaps:
    """The ``k`` best ``(score, id)`` of each of ``n`` rows: higher scores first, then smaller ids. Heaps merge."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = np.full((n, k), np.iinfo(np.int64).min, np.int64)
        self.ids = np.zeros((n, k), np.int64)
        self.held = np.zeros(n, np.int64)

    def bar(self) -> np.ndarray:
        """What a score must reach to enter: the k-th best, or the least number where there are fewer."""
        return self.scores[:, self.k - 1]

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(rows):
            return
        touched = np.unique(rows)
        own_rows = np.repeat(touched, self.held[touched])
        own = np.arange(self.k)[None, :] < self.held[touched][:, None]
        rows = np.concatenate([own_rows, rows])
        scores = np.concatenate([self.scores[touched][own], scores])
        ids = np.concatenate([self.ids[touched][own], ids])
        order = np.lexsort((ids, -scores, rows))
        rows, scores, ids = rows[order], scores[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        counts = np.diff(np.append(first, len(rows)))
        place = np.arange(len(rows)) - np.repeat(first, counts)
        best = place < self.k
        self.scores[rows[best], place[best]] = scores[best]
        self.ids[rows[best], place[best]] = ids[best]
        self.held[touched] = np.minimum(counts, self.k)

    def merge(self, other: Heaps) -> None:
        self.offer(*other.entries())

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, scores, ids) of all that is held, best first within a row."""
        taken = np.arange(self.k)[None, :] < self.held[:, None]
        return np.repeat(np.arange(len(self.held)), self.held), self.scores[taken], self.ids[taken]
