"""Token ids as Parquet list columns: dictionary pages for ids, delta pages for numbers, sized row groups, page index.

Documents are range-partitioned by id (and a hash of the text, so that a repeated id can be split), sorted, encoded in
place and written by Spark's Parquet writer. Files are in id order, and so are the rows in them; the page index lets a
reader skip to a range of ids and read ids, lengths or tokens alone. Places in the whole sequence come from distributed
prefix sums over the lengths that the files hold.

Defined cases: a null or empty text is the end id alone; a null id comes first; rows that repeat an id follow each
other in the order of their texts' hashes; an empty table is an empty file; other columns are not written; a long text
is encoded whole, in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickrank.llm import tokens
from clickrank.llm.tables import prefix_sums
from clickrank.session import stage

END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 64 << 10


def encoded(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, spaces_dropped: bool = False) -> DataFrame:
    """(doc_id, text_hash, n_tokens, tokens) for (doc_id, text_hash, text), in the given order."""
    path = vocabulary or tokens.public_file(VOCABULARY)
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path, spaces_dropped).encode_column
        for batch in batches:
            ids = [x + end for x in encode(batch.column("text"))]
            lengths = np.array([len(x) // 4 for x in ids], np.int64)
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum(lengths, out=offsets[1:])
            flat = np.frombuffer(b"".join(ids), "<i4").astype(np.int32, copy=False)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(lengths), lists],
                ["doc_id", "text_hash", "n_tokens", "tokens"],
            )

    return docs.mapInArrow(encode, "doc_id long, text_hash long, n_tokens long, tokens array<int>")


def write_tokens(
    docs: DataFrame, path: str, row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES,
    id_col: str = "doc_id", text: str = "text", **how,
) -> None:
    """Write the ids of all documents under ``path``, in ascending id order."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash")
    (
        encoded(ordered, **how)
        .write.option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#text_hash", "false")
        .option("parquet.enable.dictionary#n_tokens", "false")
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.size", str(page_bytes))
        .option("compression", "zstd")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Documents with ids from ``low`` to ``high`` (both included); the page index skips the rest of the files."""
    rows = spark.read.schema("doc_id long, text_hash long, n_tokens long, tokens array<int>").parquet(path)
    if low is not None:
        rows = rows.where(F.col("doc_id") >= low)
    return rows if high is None else rows.where(F.col("doc_id") <= high)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of everything under ``path``, read back from the files."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            flat = np.ascontiguousarray(lists.values.to_numpy(), "<i4")
            at = lists.offsets.to_numpy()
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())],
                ["doc_id", "text_hash", "n_tokens", "ids_crc32"],
            )

    rows = read_tokens(spark, path).mapInArrow(check, "doc_id long, text_hash long, n_tokens long, ids_crc32 long")
    rows = stage(rows, "token-rows")  # the range bounds are then sampled from rows without ids
    placed = prefix_sums(rows, [], [F.col("doc_id"), F.col("text_hash"), F.col("ids_crc32")], "n_tokens", "start")
    return placed.select("doc_id", "start", "n_tokens", "ids_crc32")
