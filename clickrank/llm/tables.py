"""Joins by id with a checked broadcast, distributed prefix sums and connected components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickrank.session import stage

BROADCAST_IDS = 500_000  # ids of 8 bytes that are broadcast at most; more are shuffled


def join_ids(docs: DataFrame, ids: DataFrame, how: str, id_col: str = "doc_id", limit: int = BROADCAST_IDS) -> DataFrame:
    """Semi or anti join of ``docs`` with a written one-column table of ids, broadcast only up to ``limit`` of them."""
    name = "_join_id"
    ids = ids.select(F.col(ids.columns[0]).cast("long").alias(name))
    if ids.count() <= limit:
        ids = F.broadcast(ids)
    return docs.join(ids, docs[id_col].cast("long") == ids[name], how)


def prefix_sums(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, name: str, how=F.sum) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of the same keys that come before, in ``order``.

    ``how=F.max`` gives the maximum instead, NULL where nothing comes before; a sum is 0 there.

    Rows are range-partitioned by keys and order and written once. A part adds up what it holds of a key; the sums
    of earlier parts come from one row per key and part. No task holds a key, and nulls are keys like others.
    Rows that tie in ``order`` are summed in an order that the written files fix.
    """
    spark = df.sparkSession
    by = [F.col(k).asc() for k in keys] + list(order)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = stage(
        df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_row", F.monotonically_increasing_id()),
        "placed",
    ).withColumn("_part", F.shiftright("_row", 33))
    totals = placed.groupBy(*keys, "_part").agg(how(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = totals.withColumn("_begin", how("_sum").over(earlier))
    begins = begins.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_part").alias("_in"), "_begin")
    within = Window.partitionBy("_part", *keys).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    match = F.col("_part") == F.col("_in")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    summed = placed.withColumn("_within", how(value).over(within)).join(begins, match)
    if how is F.max:
        return summed.select(*df.columns, F.greatest("_begin", "_within").alias(name))
    zero = F.lit(0)
    return summed.select(*df.columns, (F.coalesce("_begin", zero) + F.coalesce("_within", zero)).alias(name))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph given as (a, b): the component is its smallest node.

    Labels are lowered over the edges and then by pointer jumping until none changes, so rounds grow with the logarithm
    of a path's length. Every round is written to the shared folder; only the number of changes reaches the driver.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = stage(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u != v").distinct(), "edges")
    labels = stage(
        both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("component")),
        "labels",
    )
    while True:
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels["node"] == near["u"]).select(
            "node", F.col("component").alias("was"), F.least("component", "near").alias("component")
        )
        lower = stage(lower, "lower")
        onward = lower.select(F.col("node").alias("_at"), F.col("component").alias("_next"))
        jumped = lower.join(onward, lower["component"] == onward["_at"], "left").select(
            "node", "was", F.least("component", F.coalesce("_next", "component")).alias("component")
        )
        jumped = stage(jumped, "labels")
        if jumped.where("was != component").isEmpty():
            return jumped.select("node", "component")
        labels = jumped.select("node", "component")
