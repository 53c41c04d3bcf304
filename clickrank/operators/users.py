"""User sets and the user index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickrank.operators.scale import dense_index, lookup
from clickrank.schema import UNKNOWN_USER_IDX


def distinct_users(behaviors: DataFrame) -> DataFrame:
    """A1."""
    return behaviors.select("user_id").distinct()


def validation_only_users(train: DataFrame, val: DataFrame) -> DataFrame:
    """J7. Both sides are reduced to distinct users first, so no user repeats in the join."""
    return distinct_users(val).join(distinct_users(train), "user_id", "left_anti")


def user_set_union(train: DataFrame, val: DataFrame) -> DataFrame:
    """A9."""
    return distinct_users(train).unionByName(distinct_users(val)).distinct()


def build_user_index(train: DataFrame, val: DataFrame) -> DataFrame:
    """A2: training users numbered from 1 in ascending order, users seen only in validation get 0."""
    known = dense_index(distinct_users(train), [F.col("user_id").asc()], "user_idx")
    unseen = validation_only_users(train, val).select("user_id", F.lit(UNKNOWN_USER_IDX).cast("long").alias("user_idx"))
    return known.unionByName(unseen)


def user_count(user_index: DataFrame, only_train: bool) -> DataFrame:
    """A3: training users, or all indexed users. A model needs one more row than that."""
    counted = user_index.where(F.col("user_idx") != UNKNOWN_USER_IDX) if only_train else user_index
    return counted.agg(F.count(F.lit(1)).alias("n_users"), (F.count(F.lit(1)) + 1).alias("model_rows"))


def attach_user_idx(behaviors: DataFrame, user_index: DataFrame) -> DataFrame:
    """Users outside the index get 0."""
    joined = lookup(behaviors, user_index.select("user_id", "user_idx"), "user_id")
    return joined.withColumn("user_idx", F.coalesce("user_idx", F.lit(UNKNOWN_USER_IDX).cast("long")))
