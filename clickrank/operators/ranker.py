"""A click ranker on all products of user and candidate vector, fitted by Newton steps.

A step needs the gradient and the Gram matrix of one sample. Every partition adds up its own rows in dense arithmetic and
leaves as one row of numbers, whatever it holds; partitions combine in a tree, in their order, so that equal
partitions give equal weights. The driver sees the last few sums and solves a system of the size of a vector.
Scoring is a weighted product-sum in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickrank.functions.dense import vector_array
from clickrank.functions.vectors import dot, product
from clickrank.operators.scale import lookup
from clickrank.operators.scoring import SCORE_DECIMALS

FAN_IN = 64  # sums that one task of the tree adds up


@dataclass(frozen=True)
class LinearRanker:
    """score = intercept + sum of weight * user component * candidate component."""

    intercept: float
    coefficients: tuple[float, ...]

    @staticmethod
    def zeros(dim: int) -> LinearRanker:
        return LinearRanker(0.0, (0.0,) * dim)


@dataclass(frozen=True)
class Epoch:
    """What one pass saw: rows, and their mean loss under the weights that it started from."""

    epoch: int
    rows: int
    loss: float | None


def as_linear(model: LinearRanker | LogisticRegressionModel) -> LinearRanker:
    if isinstance(model, LinearRanker):
        return model
    return LinearRanker(float(model.intercept), tuple(float(w) for w in model.coefficients))


def with_products(
    candidates: DataFrame, news_vectors: DataFrame, empty: Sequence[float] | None = None, fits: bool | None = None
) -> DataFrame:
    """``product`` of candidate and user vector in place of ``user_vec``; NULL without a user vector.

    Fillers and other ids without a vector have that of the empty news (zeros unless given).
    """
    joined = lookup(candidates, news_vectors.select("news_id", "vec"), "news_id", fits=fits)
    user = F.col("user_vec")
    none = F.transform(user, lambda x: F.lit(0.0)) if empty is None else F.array(*[F.lit(float(x)) for x in empty])
    kept = [c for c in candidates.columns if c != "user_vec"]
    return joined.select(*kept, product(F.coalesce("vec", none), user).alias("product"))


# ---------------------------------------------------------------- fitting


def _sums(x: np.ndarray, clicked: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """[rows, loss, gradient, upper half of the Gram matrix] of a batch; ``x`` begins with a column of ones."""
    z = x @ weights
    p = np.exp(-np.logaddexp(0.0, -z))
    gram = x.T @ (x * (p * (1 - p))[:, None])
    loss = (np.logaddexp(0.0, z) - clicked * z).sum()
    return np.concatenate([[len(x), loss], x.T @ (p - clicked), gram[np.triu_indices(x.shape[1])]])


def partition_sums(products: DataFrame, ranker: LinearRanker) -> DataFrame:
    """``(part, sums)``: one row per partition. Rows without a label or a product are left out."""
    weights = np.array([ranker.intercept, *ranker.coefficients])
    dim = len(weights)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + dim + dim * (dim + 1) // 2)
        for batch in batches:
            lengths = np.asarray(batch.column("product").value_lengths())
            if (lengths != dim - 1).any():
                raise ValueError(f"products of {sorted(set(lengths.tolist()))} numbers for {dim - 1} weights")
            flat = np.asarray(batch.column("product").flatten(), dtype=np.float64).reshape(len(batch), dim - 1)
            clicked = np.asarray(batch.column("clicked"), dtype=np.float64)
            total += _sums(np.hstack([np.ones((len(flat), 1)), flat]), clicked, weights)
        part = pa.array([TaskContext.get().partitionId()], pa.int32())
        yield pa.RecordBatch.from_arrays([part, vector_array(total[None, :])], names=["part", "sums"])

    known = products.where(F.col("product").isNotNull() & F.col("clicked").isNotNull())
    return known.select("product", F.col("clicked").cast("double").alias("clicked")).mapInArrow(add, "part int, sums array<double>")


def tree_sums(parts: DataFrame, levels: int = 2, fan_in: int = FAN_IN) -> np.ndarray | None:
    """Sum of the rows of ``partition_sums``; after the levels of the tree one row in ``fan_in ** levels`` is left."""

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(table.column("part")), kind="stable")
        rows = np.asarray(table.column("sums").combine_chunks().flatten()).reshape(len(order), -1)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "sums": vector_array(rows[order].sum(axis=0)[None, :])})

    for _ in range(levels):
        group = F.floor(F.col("part") / fan_in).cast("int").alias("_group")
        parts = parts.groupBy(group).applyInArrow(add, "part int, sums array<double>")
    rows = sorted(parts.collect())
    return np.sum([r["sums"] for r in rows], axis=0) if rows else None


def newton_step(products: DataFrame, ranker: LinearRanker, weight_decay: float = 0.0) -> tuple[LinearRanker, int, float | None]:
    """(weights after one step on mean loss + weight_decay / 2 * |coefficients|^2, rows, mean loss before it).

    Directions in which the rows say nothing are not moved along. Without rows the weights stay.
    """
    sums = tree_sums(partition_sums(products, ranker))
    if sums is None or not sums[0]:
        return ranker, 0, None
    weights = np.array([ranker.intercept, *ranker.coefficients])
    dim, n = len(weights), sums[0]
    gram = np.zeros((dim, dim))
    gram[np.triu_indices(dim)] = sums[2 + dim :] / n
    gram += np.triu(gram, 1).T
    decay = np.full(dim, weight_decay)
    decay[0] = 0.0
    step = np.linalg.lstsq(gram + np.diag(decay), sums[2 : 2 + dim] / n + decay * weights, rcond=None)[0]
    moved = weights - step
    return LinearRanker(float(moved[0]), tuple(moved[1:].tolist())), int(n), float(sums[1] / n)


def fit_epochs(
    products_of: Callable[[int], DataFrame], dim: int, epochs: int = 3, weight_decay: float = 0.0, start: LinearRanker | None = None
) -> tuple[LinearRanker, list[Epoch]]:
    """One step per epoch on that epoch's own sample, from the weights of the epoch before."""
    ranker, seen = start or LinearRanker.zeros(dim), []
    for epoch in range(epochs):
        ranker, rows, loss = newton_step(products_of(epoch), ranker, weight_decay)
        seen.append(Epoch(epoch, rows, loss))
    return ranker, seen


# ---------------------------------------------------------------- weights as a table


def weight_table(spark: SparkSession, ranker: LinearRanker) -> DataFrame:
    """``(place, weight)``; the intercept has place 0."""
    return spark.createDataFrame(list(enumerate([ranker.intercept, *ranker.coefficients])), "place int, weight double")


def save_weights(spark: SparkSession, ranker: LinearRanker, path: str) -> None:
    weight_table(spark, ranker).coalesce(1).write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> LinearRanker:
    """As many numbers as a vector has, and one."""
    rows = sorted(spark.read.parquet(path).select("place", "weight").collect())
    if [r["place"] for r in rows] != list(range(len(rows))) or not rows:
        raise ValueError(f"{path} is no table of weights")
    return LinearRanker(rows[0]["weight"], tuple(r["weight"] for r in rows[1:]))


# ---------------------------------------------------------------- scoring


def score_linear(
    candidates: DataFrame,
    news_vectors: DataFrame,
    ranker: LinearRanker | LogisticRegressionModel,
    empty: Sequence[float] | None = None,
    fits: bool | None = None,
) -> DataFrame:
    """``score`` of every candidate with ``user_vec``; NULL without a user vector, unknown news as the empty one."""
    linear = as_linear(ranker)
    rows = with_products(candidates, news_vectors, empty, fits)
    kept = [c for c in rows.columns if c != "product"]
    weights = F.array(*[F.lit(float(w)) for w in linear.coefficients])
    return rows.select(*kept, F.round(dot(F.col("product"), weights) + linear.intercept, SCORE_DECIMALS).alias("score"))
