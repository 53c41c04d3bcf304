"""Exact dedup against a persistent digest index, bucketed and sorted by hash.

The index is a Parquet table ``(digest, keep_id, n_chars, group_size)`` of ``buckets`` buckets, each sorted by digest.
A batch is reduced to one row per digest on the map side, loses the digests that the index has by a sort-merge
anti-join (the index side is neither shuffled nor broadcast), and what is new is appended. Within a batch the row with
the most code points stays, then the smallest id. An indexed digest keeps its row for ever, so a batch that is run
again after a failure gets the same answer. ``group_size`` counts the rows of the batch that brought the digest.

Defined cases: a null text counts as empty; rows with equal text, id and all are one group, of which exactly one id
stays (repeated rows of one id stay or go together); a null id loses to any other and is a group's ``keep_id`` only
if the group has no other; an empty batch appends nothing; extra columns are ignored or, in ``drop_duplicates``, kept.
Long texts only pass through built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickrank.llm.tables import join_ids
from clickrank.session import scratch_path, stage

INDEX_SCHEMA = "digest binary, keep_id bigint, n_chars bigint, group_size bigint"


def normalised(text: Column) -> Column:
    """The text without any ASCII white space."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\f\r", "")


def digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, digest of the normalised text, code points of the original); no exchange."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.unhex(F.sha2(normalised(F.col(text)), 256)).alias("digest"),
        F.coalesce(F.char_length(F.col(text)), F.lit(0)).cast("long").alias("n_chars"),
    )


class DigestIndex:
    """A bucketed index under a path that all executors share; opened again by the same path."""

    def __init__(self, spark: SparkSession, path: str, table: str, buckets: int):
        self.spark, self.path, self.table, self.buckets = spark, path, table, buckets
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({INDEX_SCHEMA}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, batch: DataFrame) -> None:
        """Add the digests of a batch (as from ``digests``) that the index does not have."""
        best = F.struct(F.col("n_chars"), F.col("doc_id").isNotNull(), -F.col("doc_id"))
        groups = batch.groupBy("digest").agg(
            F.max_by("doc_id", best).alias("keep_id"),
            F.max("n_chars").alias("n_chars"),
            F.count(F.lit(1)).alias("group_size"),
        )
        # Written first: an anti-join is otherwise moved below the aggregate, where a hot digest is still all its rows.
        new = stage(groups, "batch-digests").join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        (
            new.select("digest", "keep_id", "n_chars", "group_size")
            .repartition(self.buckets, "digest")
            .write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)
        )

    def drop(self) -> None:
        """Forget the table's name; its files stay, and so do the decisions read from them."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def deduplicate(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Append a batch to the index and decide each of its rows: doc_id, digest, keep_id, group_size, kept.

    The digests are written once, so that texts are read once. The join back reads the index's files as a plain table,
    because adaptive execution splits a partition that a large group of copies fills only if both sides are shuffled.
    """
    batch = stage(digests(docs, id_col, text), "digests")
    index.append(batch)
    found = index.spark.read.schema(INDEX_SCHEMA).parquet(index.path).select("digest", "keep_id", "group_size")
    return batch.join(found, "digest").select(
        "doc_id", "digest", "keep_id", "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull() & F.col("doc_id").isNull()).alias("kept"),
    )


def new_index(spark: SparkSession, buckets: int | None = None) -> DigestIndex:
    """An empty index in a new shared folder, by default of as many buckets as shuffles have partitions."""
    path = scratch_path(spark, "digest-index")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return DigestIndex(spark, path, "digest_index_" + path.rsplit("-", 1)[-1], buckets)


def drop_duplicates(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text: str = "text", repeats: bool = True) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns.

    Rows that repeat an id and text stay together; without ``repeats`` one of them stays, of the most code points.
    Only rows of an id that loses a row, or repeats one, are compared by digest; the others pass without being moved as
    long as these ids can be broadcast.
    """
    # Written, so that the join before it can split a large group of copies.
    decided = stage(deduplicate(docs, index, id_col, text), "decided")
    if not repeats:
        again = decided.where("kept").groupBy("doc_id", "digest").count().where("count > 1")
        again = stage(again.select("doc_id", "digest"), "again")
    gone = stage(decided.where(~F.col("kept")).select("doc_id", "digest").distinct(), "gone")
    named = docs.where(docs[id_col].isNotNull())
    ids = gone if repeats else gone.union(again)
    ids = ids.where("doc_id IS NOT NULL").select("doc_id").distinct()
    ids = ids if repeats else stage(ids, "doubtful")
    doubtful = join_ids(named, ids, "left_semi", id_col).unionByName(docs.where(docs[id_col].isNull()))
    mine = F.unhex(F.sha2(normalised(F.col(text)), 256))

    def among(found: DataFrame, how: str) -> DataFrame:
        return doubtful.join(found, doubtful[id_col].cast("long").eqNullSafe(found["doc_id"]) & (mine == found["digest"]), how)

    passed = join_ids(named, ids, "left_anti", id_col)
    if repeats:
        return passed.unionByName(among(gone, "left_anti"))
    once = among(gone.union(again), "left_anti")
    # Combined on the map side, so that no task holds a row that is repeated many times.
    row, size = F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(F.char_length(text), F.xxhash64(text))
    one = among(again, "left_semi").groupBy(F.col(id_col).cast("long").alias("_id"), mine.alias("_digest")).agg(F.max_by(row, size).alias("_row"))
    return passed.unionByName(once).unionByName(one.select("_row.*"))
