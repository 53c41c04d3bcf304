"""Packing documents into windows by multiway differencing (Karmarkar-Karp).

A document's ids and the end id are cut into whole windows of ``size``, which are packed as they are, and a rest, cut
into blocks of ``block`` ids. Blocks are dealt in hash order into equal groups of about ``GROUP``, and each group is
partitioned into near-equal windows: every block starts as a partition with one loaded window; the two partitions with
the largest imbalance are merged, heaviest window onto lightest, until one is left. If a window exceeds its capacity,
the number of windows rises and the group is partitioned again.

Cutting depends on a document's length only, so the checksum of a piece is taken where the text is encoded and no ids
need to move; ``with_ids=True`` carries them along. Groups are bounded by construction, whatever the sources or
documents; only numbers of blocks reach the driver.

Defined cases: null and empty texts are one end id; rows that repeat an id are packed each; null ids are kept; ties go
by hash and order; an empty table has no windows; other columns are ignored; a long text is encoded whole, in memory
of a few times its length, in one task.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickrank.llm import tokens
from clickrank.operators.scale import dense_index
from clickrank.session import stage

SIZE = 2048
BLOCK = 512
GROUP = 1024
END_ID = 1
VOCABULARY = "word_bpe_49k.json"


def differencing(lengths: np.ndarray, k: int) -> list[list[int]]:
    """Indexes of ``lengths`` in ``k`` sets of near-equal sums.

    A partition is its loaded windows, heaviest first, less the load of its lightest one.
    """
    heap = [(-int(n), i, np.array([n], np.int64), [[i]]) for i, n in enumerate(lengths.tolist())]
    heapq.heapify(heap)
    ticket = len(heap)
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        free = k - len(a) - len(b)
        if free >= 0:
            loads = np.concatenate([a, b])
            members = in_a + in_b
        else:
            loads = np.concatenate([a, np.zeros(k - len(a), np.int64)])
            loads[k - len(b) :] += b[::-1]
            members = in_a + [[] for _ in range(k - len(a))]
            for at, more in enumerate(in_b):
                members[k - 1 - at] = members[k - 1 - at] + more
        order = np.argsort(-loads, kind="stable")
        loads, members = loads[order], [members[i] for i in order.tolist()]
        if free <= 0:
            loads = loads - loads[-1]
        heapq.heappush(heap, (-int(loads[0]), ticket, loads, members))
        ticket += 1
    members = heap[0][3] if heap else []
    return members + [[] for _ in range(k - len(members))]


def windows(lengths: np.ndarray, size: int = SIZE) -> list[list[int]]:
    """Sets whose sums are at most ``size``; no length may exceed it."""
    k = max(1, -(-int(lengths.sum()) // size))
    while True:
        sets = differencing(lengths, k)
        over = sum(max(0, int(lengths[s].sum()) - size) for s in sets)
        if not over:
            return [s for s in sets if s]
        k += max(1, over // size)


def cuts(n: int, size: int = SIZE, block: int = BLOCK) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids."""
    whole = n - n % size
    return [(s, size) for s in range(0, whole, size)] + [(s, min(block, n - s)) for s in range(whole, n, block)]


def encoded_pieces(
    docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, size: int = SIZE, block: int = BLOCK,
    with_ids: bool = False, id_col: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Rows of (doc_id, start, length, ids_crc32, doc_tokens[, ids]); one pass, no exchange."""
    path = vocabulary or tokens.public_file(VOCABULARY)
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path, True).encode_column
        for batch in batches:
            rows, at, parts = [], [], []
            for i, one in enumerate(encode(batch.column("text"))):
                ids = one + end
                n = len(ids) // 4
                for start, length in cuts(n, size, block):
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append((start, length, zlib.crc32(part), n))
                    at.append(i)
                    if with_ids:
                        parts.append(part)
            numbers = np.array(rows, np.int64).reshape(-1, 4)
            columns = [batch.column("doc_id").take(pa.array(at, pa.int64()))] + [pa.array(numbers[:, c]) for c in range(4)]
            if with_ids:
                columns.append(pa.array(parts, pa.binary()))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
            yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, schema)


def pack(docs: DataFrame, size: int = SIZE, group: int = GROUP, **how) -> DataFrame:
    """The pieces of ``docs`` with sequence_id and offset. ``how`` goes to ``encoded_pieces``.

    Whole windows have odd sequence ids, windows of blocks even ones.
    """
    found = stage(encoded_pieces(docs, size=size, **how), "pieces")
    whole = found.where(F.col("length") == size).withColumn("_row", F.monotonically_increasing_id())
    whole = whole.select(*found.columns, (2 * F.col("_row") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    blocks = found.where(F.col("length") < size)
    n = blocks.count()
    groups = max(1, round(n / group))
    order = [F.xxhash64("doc_id", "start", "ids_crc32"), *[F.col(c) for c in ("doc_id", "start", "ids_crc32")]]
    dealt = dense_index(blocks, [*order, F.col("doc_tokens")], "_place", 0).withColumn("_group", F.floor(F.col("_place") / (max(1, n) / groups)))
    dealt = dealt.repartition(F.col("_group")).sortWithinPartitions("_group", "_place")

    def place(key: tuple, table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for w, members in enumerate(windows(lengths, size)):
            members = sorted(members)
            sequence[members] = 2 * (key[0].as_py() * 2 * group + w)
            offset[members] = np.cumsum(lengths[members]) - lengths[members]
        kept = table.select([c for c in table.column_names if c[0] != "_"])
        return kept.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields) + ", sequence_id long, offset long"
    return whole.unionByName(dealt.groupBy("_group").applyInArrow(place, schema))
