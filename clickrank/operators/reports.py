"""A10: comparison of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ("auc", "mrr", "ndcg_at_5", "ndcg_at_10")


def compare_runs(metrics: DataFrame, methods: Sequence[str], ours: str) -> DataFrame:
    """Macro-averages per (model, backbone) and metric with one column per text method, and the gain of ``ours``
    over each other method as ``gain_over_{method}``.

    The rows of all runs meet in one map-side combined aggregate; only its handful of results is pivoted.
    """
    means = metrics.groupBy("model", "backbone", "method").agg(*[F.avg(m).alias(m) for m in METRICS])
    long = means.unpivot(["model", "backbone", "method"], list(METRICS), "metric", "value")
    wide = long.groupBy("model", "backbone", "metric").pivot("method", list(methods)).agg(F.first("value"))
    gains = [
        F.when(F.col(m) != 0, F.col(ours) / F.col(m) - 1).alias(f"gain_over_{m}") for m in methods if m != ours
    ]
    return wide.select("*", *gains)
