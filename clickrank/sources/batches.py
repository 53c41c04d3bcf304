"""X7 as files: batches of a random order written so that a trainer opens one file for one batch.

A file holds a run of batches in order. The index, one row per file with its first and last batch, is written last, so a
folder with an index is complete.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickrank.operators.lookup import IMPRESSION
from clickrank.operators.sampling import assign_batches


def write_batches(
    examples: DataFrame, path: str, batch_size: int, seed: int, epoch: int = 0, batches_per_file: int = 64, keys: Sequence[str] = IMPRESSION
) -> None:
    """The rows of ``examples`` with ``batch`` and ``place``, ordered by both; only the last batch may be short.

    Rows of a file meet in one task, ``batch_size * batches_per_file`` of them at most. ``path`` must not hold batches yet.
    An empty table leaves an empty index.
    """
    placed = assign_batches(examples, batch_size, seed, epoch, keys)
    run = F.floor(F.col("batch") / batches_per_file)
    ordered = placed.withColumn("run", run).repartition("run").sortWithinPartitions("run", "batch", "place")
    ordered.write.partitionBy("run").parquet(f"{path}/data")
    spark = examples.sparkSession
    rows = spark.read.schema(ordered.schema).parquet(f"{path}/data").select("batch", F.col("_metadata.file_path").alias("file"))
    files = rows.groupBy("file").agg(F.min("batch").alias("first"), F.max("batch").alias("last"), F.count(F.lit(1)).alias("rows"))
    # Parts of the index cover ranges of batches, so that their statistics lead to one of them.
    files.repartitionByRange("first").sortWithinPartitions("first").write.parquet(f"{path}/index")


def batch_index(spark: SparkSession, path: str) -> DataFrame:
    """``(file, first, last, rows)``."""
    return spark.read.parquet(f"{path}/index")


def read_batch(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """The rows of one batch, in order of ``place``, from the one file that has them; ``IndexError`` if there is none."""
    found = batch_index(spark, path).where((F.col("first") <= batch) & (F.col("last") >= batch)).select("file").collect()
    if not found:
        raise IndexError(f"batch {batch} is not in {path}")
    return spark.read.parquet(found[0]["file"]).where(F.col("batch") == batch).orderBy("place")


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All rows with ``run``, the number of their file."""
    return spark.read.parquet(f"{path}/data")
