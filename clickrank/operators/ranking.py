"""Ranking of scored candidates and metrics per impression.

Input is ``scored(impression_id, pos, clicked, score)`` with labels 0 or 1. Equal scores are ordered by
position, last first. ``bounded=True`` says impressions are small, as when they come from log rows of limited
length; without it their sizes are counted first, and the rows of oversize impressions are range-sorted over
many tasks instead of windowed in one.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickrank.operators.scale import HOT_ROWS, hot_groups, number_rows, range_number, split_hot

IMPRESSION = ("impression_id",)


def _by_score() -> list[Column]:
    return [F.col("score").desc(), F.col("pos").desc()]


def _by_label() -> list[Column]:
    return [F.col("clicked").desc(), F.col("pos").desc()]


def rank_candidates(scored: DataFrame, bounded: bool = False, limit: int = HOT_ROWS, keys: Sequence[str] = IMPRESSION) -> DataFrame:
    """``rank`` 1 for the best score of the impression."""
    return number_rows(scored, keys, _by_score(), "rank", bounded=bounded, limit=limit)


def ideal_rank(scored: DataFrame, bounded: bool = False, limit: int = HOT_ROWS, keys: Sequence[str] = IMPRESSION) -> DataFrame:
    """The same order by label, which normalises nDCG."""
    return number_rows(scored, keys, _by_label(), "ideal_rank", bounded=bounded, limit=limit)


def _first_k(scored: DataFrame, order: list[Column], k: int, keys: Sequence[str]) -> DataFrame:
    # The rank filter becomes a group limit that runs before the shuffle: no task gets more than
    # k rows per impression and input part, however large the impression.
    window = Window.partitionBy(*keys).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(window).cast("long")).where(F.col("rank") <= k)


def top_k(scored: DataFrame, k: int, keys: Sequence[str] = IMPRESSION) -> DataFrame:
    """W2."""
    return _first_k(scored, _by_score(), k, keys)


def _discounted() -> Column:
    return (F.pow(F.lit(2.0), F.col("clicked")) - 1) / F.log2(F.col("rank") + 1)


def dcg_at_k(scored: DataFrame, k: int, bounded: bool = False, limit: int = HOT_ROWS, keys: Sequence[str] = IMPRESSION) -> DataFrame:
    """Sum of (2^label - 1) / log2(rank + 1) over the first k ranks; NULL as in ``evaluate``."""
    return _sums(scored, (k,), bounded, limit, keys).select(*keys, _complete(F.col(f"dcg_{k}")).alias("dcg"))


def ndcg_at_k(scored: DataFrame, k: int, bounded: bool = False, limit: int = HOT_ROWS, keys: Sequence[str] = IMPRESSION) -> DataFrame:
    """DCG over the DCG of the best possible order, which follows from the number of positives; NULL without one."""
    sums = _sums(scored, (k,), bounded, limit, keys)
    return sums.select(*keys, _complete(_ratio(F.col(f"dcg_{k}"), _ideal(k))).alias("ndcg"))


def _ratio(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b != 0, a / b)


def _measures(ks: tuple[int, ...]) -> list[Column]:
    """Sums over ranked rows with tie statistics, from which every metric follows."""
    clicked = F.col("clicked")
    return [
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("score").isNotNull() & clicked.isNotNull(), 1)).alias("n_known"),
        F.sum(clicked).alias("positives"),
        F.sum(clicked / F.col("rank")).alias("reciprocal"),
        *[F.sum(F.when(F.col("rank") <= k, _discounted()).otherwise(0.0)).alias(f"dcg_{k}") for k in ks],
    ]


def _ideal(k: int) -> Column:
    sums, total = [0.0], 0.0
    for place in range(1, k + 1):
        total += 1.0 / log2(place + 1)
        sums.append(total)
    table = F.array(*[F.lit(s) for s in sums])
    return F.element_at(table, (F.least(F.col("positives"), F.lit(k)) + 1).cast("int"))


def _sums(scored: DataFrame, ks: tuple[int, ...], bounded: bool, limit: int, keys: Sequence[str]) -> DataFrame:
    """Per impression: counts, reciprocal-rank and DCG sums, and the sum of mid-ranks of the positives."""
    rows = scored.select(*keys, "pos", "clicked", "score")
    by_score = Window.partitionBy(*keys).orderBy(*_by_score())
    peers = Window.partitionBy(*keys).orderBy(F.col("score").desc())
    tied = peers.rangeBetween(Window.currentRow, Window.currentRow)
    midrank = F.col("first") + (F.col("ties") - 1) / 2

    def windowed(part: DataFrame) -> DataFrame:
        # One exchange and one sort serve both windows and the aggregate.
        ranked = part.select(
            "*",
            F.row_number().over(by_score).alias("rank"),
            F.rank().over(peers).alias("first"),
            F.count(F.lit(1)).over(tied).alias("ties"),
        )
        return ranked.groupBy(*keys).agg(*_measures(ks), F.sum(F.col("clicked") * midrank).alias("midranks"))

    hot = None if bounded else hot_groups(rows, keys, limit)
    if hot is None:
        return windowed(rows)
    ordinary, heavy = split_hot(rows, hot, keys)
    # Equal scores are consecutive, so a group of ties needs only its first rank and its size; both levels
    # of aggregation combine on the map side.
    ties = (
        range_number(heavy, keys, _by_score(), "rank")
        .groupBy(*keys, "score")
        .agg(*_measures(ks), F.min("rank").alias("first"))
        .withColumn("ties", F.col("n"))
    )
    summed = ["n", "n_known", "positives", "reciprocal", *[f"dcg_{k}" for k in ks]]
    spread = ties.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in summed], F.sum(F.col("positives") * midrank).alias("midranks")
    )
    return windowed(ordinary).unionByName(spread)


def _auc() -> Column:
    p, n = F.col("positives"), F.col("n")
    # Mid-ranks were taken from the best score down; turned round they count from the worst up.
    ascending = p * (n + 1) - F.col("midranks")
    return _ratio(ascending - p * (p + 1) / 2, p * (n - p))


def _complete(metric: Column) -> Column:
    """NULL where a candidate has no score or no label."""
    return F.when(F.col("n_known") == F.col("n"), metric)


def mrr(scored: DataFrame, bounded: bool = False, limit: int = HOT_ROWS, keys: Sequence[str] = IMPRESSION) -> DataFrame:
    """Mean reciprocal rank over all positives of the impression."""
    return _sums(scored, (), bounded, limit, keys).select(*keys, _complete(_ratio("reciprocal", "positives")).alias("mrr"))


def auc(scored: DataFrame, bounded: bool = False, limit: int = HOT_ROWS, keys: Sequence[str] = IMPRESSION) -> DataFrame:
    """Area under the ROC curve, ties counting half; NULL without a positive or a negative."""
    return _sums(scored, (), bounded, limit, keys).select(*keys, _complete(_auc()).alias("auc"))


def evaluate(scored: DataFrame, bounded: bool = False, limit: int = HOT_ROWS, keys: Sequence[str] = IMPRESSION) -> DataFrame:
    """The four metrics per impression. A missing score or label makes them NULL."""
    sums = _sums(scored, (5, 10), bounded, limit, keys)
    return sums.select(
        *keys,
        _complete(_ratio(F.col("dcg_5"), _ideal(5))).alias("ndcg_at_5"),
        _complete(_ratio(F.col("dcg_10"), _ideal(10))).alias("ndcg_at_10"),
        _complete(_auc()).alias("auc"),
        _complete(_ratio("reciprocal", "positives")).alias("mrr"),
    )


def macro_average(metrics: DataFrame, *by: str) -> DataFrame:
    """Unweighted means over impressions; NULL metrics are left out and the counts say how many were not."""
    return metrics.groupBy(*by).agg(
        F.count(F.lit(1)).alias("impressions"),
        F.count("mrr").alias("with_positive"),
        F.count("auc").alias("with_auc"),
        *[F.avg(m).alias(m) for m in ("ndcg_at_5", "ndcg_at_10", "auc", "mrr")],
    )


def evaluate_run(scored: DataFrame, bounded: bool = False, limit: int = HOT_ROWS, keys: Sequence[str] = IMPRESSION) -> DataFrame:
    """One row for the whole run."""
    return macro_average(evaluate(scored, bounded, limit, keys))
