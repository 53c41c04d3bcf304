"""Hard negatives: anchors against all rows in tiles multiplied by Strassen's method, with mergeable heaps.

Rows are dealt to equal shards by row number and anchors copied to each. In a shard, an anchor tile times a candidate
tile gives exact integer scores. The first pass multiplies an anchor only with rows of its own label and keeps a heap of
positives per anchor; heaps of shards merge into the best positives of each anchor. The second pass multiplies it with
all rows and keeps, for each of its positives, a heap of the best rows of other labels whose score is in the window that
the positive's score sets; heaps of shards merge again. Nothing is kept of a score that enters no heap.

Memory of a task: one shard, ``PART_ROWS`` anchors or so and one tile of scores. Shards are copied once per part of
anchors; nothing is collected or broadcast. A label that holds a third of the rows is spread over all shards.

Defined cases: rows without an id or a label, and vectors that are null or hold null or non-finite components, take no
part; vectors of unequal length are filled up with zeros; an empty vector scores 0. Ties go to the smaller id. An
anchor's own id is no candidate of it, however often it is there; other rows that repeat are candidates each, an anchor
row that repeats is answered as often, and positives that repeat are positives each. A positive without a score in its
window (always so when its score is below 0) gives no rows. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickrank.llm import vectors as v
from clickrank.llm.strassen import multiply
from clickrank.session import stage

ANCHOR_TILE, CANDIDATE_TILE = 512, 1024
_FIRST = "_row long, _id long, _label long, _positive_id long, _score long"
_SECOND = "_row long, _id long, _place int, _positive_id long, _positive_score long, _negative_id long, _score long"


@dataclass(frozen=True)
class Window100:
    """``low * positive <= 100 * negative <= high * positive`` in whole hundredths."""

    low: int = 50
    high: int = 95

    def limits(self, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, largest) negative score of each positive score, without leaving 64 bits."""
        whole, rest = np.divmod(positive, 100)
        return whole * self.low - (-rest * self.low) // 100, whole * self.high + (rest * self.high) // 100


def _tiles(n: int, size: int):
    return [slice(i, min(i + size, n)) for i in range(0, n, size)]


def positives_of_shard(
    anchors: np.ndarray, own: np.ndarray, anchor_labels: np.ndarray, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, k: int
) -> v.Heaps:
    """The best other rows of the same label; tiles hold one label."""
    heaps = v.Heaps(len(anchors), k)
    by_anchor, by_row = np.argsort(anchor_labels, kind="stable"), np.argsort(labels, kind="stable")
    for label in np.intersect1d(anchor_labels, labels):
        mine = by_anchor[slice(*np.searchsorted(anchor_labels[by_anchor], [label, label + 1]))]
        theirs = by_row[slice(*np.searchsorted(labels[by_row], [label, label + 1]))]
        for c in _tiles(len(theirs), CANDIDATE_TILE):
            columns = np.ascontiguousarray(x[theirs[c]].T)
            for r in _tiles(len(mine), ANCHOR_TILE):
                rows = mine[r]
                scores = multiply(anchors[rows], columns)
                enter = (scores >= heaps.bar()[rows][:, None]) & (ids[theirs[c]][None, :] != own[rows][:, None])
                hit, where = np.nonzero(enter)
                heaps.offer(rows[hit], scores[hit, where], ids[theirs[c]][where])
    return heaps


def negatives_of_shard(
    anchors: np.ndarray, own: np.ndarray, anchor_labels: np.ndarray, positive: np.ndarray, there: np.ndarray,
    x: np.ndarray, ids: np.ndarray, labels: np.ndarray, k: int, window: Window100,
) -> v.Heaps:
    """One heap for each anchor and place of a positive (row ``anchor * places + place``)."""
    places = positive.shape[1]
    heaps = v.Heaps(len(anchors) * places, k)
    least, most = window.limits(positive)
    for c in _tiles(len(x), CANDIDATE_TILE):
        columns = np.ascontiguousarray(x[c].T)
        for r in _tiles(len(anchors), ANCHOR_TILE):
            scores = multiply(anchors[r], columns)
            other = (labels[c][None, :] != anchor_labels[r][:, None]) & (ids[c][None, :] != own[r][:, None])
            slots = np.arange(r.start, r.stop) * places
            for place in range(places):
                floor = np.maximum(least[r, place], heaps.bar()[slots + place])
                enter = (scores >= floor[:, None]) & (scores <= most[r, place][:, None])
                hit, where = np.nonzero(enter & other & there[r, place][:, None])
                heaps.offer(slots[hit] + place, scores[hit, where], ids[c][where])
    return heaps


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [np.asarray(table.column(n)).astype(np.int64) for n in names]


def _first(rows: DataFrame, order: Window, k: int) -> DataFrame:
    return rows.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k)


def _positives(shards: DataFrame, anchors: DataFrame, k: int, dim: int, scale: float) -> DataFrame:
    def look(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in ("_row", "_id", "_label", "_positive_id", "_score")})
        rows, own, label = _columns(asked, "_row", "_id", "_label")
        ids, labels = _columns(held, "_id", "_label")
        a, x = v.integers(asked.column("_vec"), scale, dim), v.integers(held.column("_vec"), scale, dim)
        v.require_fit(a, x)
        which, scores, hits = positives_of_shard(a, own, label, x, ids, labels, k).entries()
        columns = (rows[which], own[which], label[which], hits, scores)
        return pa.table({n: pa.array(c) for n, c in zip(("_row", "_id", "_label", "_positive_id", "_score"), columns)})

    keys = ["_shard", "_part"]
    found = anchors.groupBy(*keys).cogroup(shards.groupBy(*keys)).applyInArrow(look, _FIRST)
    return _first(found, Window.partitionBy("_row").orderBy(F.desc("_score"), "_positive_id"), k)


def _negatives(shards: DataFrame, anchors: DataFrame, places: int, k: int, dim: int, scale: float, window: Window100) -> DataFrame:
    names = ("_row", "_id", "_place", "_positive_id", "_positive_score", "_negative_id", "_score")
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def look(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, kinds)})
        rows, own, label = _columns(asked, "_row", "_id", "_label")
        ids, labels = _columns(held, "_id", "_label")
        a, x = v.integers(asked.column("_vec"), scale, dim), v.integers(held.column("_vec"), scale, dim)
        v.require_fit(a, x)
        chosen = asked.column("_positives").combine_chunks()
        counts = np.asarray(chosen.value_lengths()).astype(np.int64)
        there = np.arange(places)[None, :] < counts[:, None]
        positive, positive_ids = np.zeros((2, len(rows), places), np.int64)
        flat = chosen.flatten()
        positive[there], positive_ids[there] = (np.asarray(flat.field(n)).astype(np.int64) for n in ("_score", "_positive_id"))
        heaps = negatives_of_shard(a, own, label, positive, there, x, ids, labels, k, window)
        which, scores, hits = heaps.entries()
        at, place = np.divmod(which, places)
        columns = (rows[at], own[at], place + 1, positive_ids[at, place], positive[at, place], hits, scores)
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, kinds)})

    keys = ["_shard", "_part"]
    found = anchors.groupBy(*keys).cogroup(shards.groupBy(*keys)).applyInArrow(look, _SECOND)
    order = Window.partitionBy("_row", "_place").orderBy(F.desc("_score"), "_negative_id")
    return found.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)


def mine(
    df: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 3, window: Window100 = Window100(),
    id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256, shard_rows: int = v.SHARD_ROWS, part_rows: int = v.PART_ROWS,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` of every row that ``is_anchor`` names."""
    labelled = df.where(label.isNotNull())
    rows = v.usable_rows(labelled, id_col, vec_col, _label=label.cast("long"), _anchors=F.coalesce(is_anchor, F.lit(False)))
    n, dim = v.shape(rows)
    count = v.shard_count(rows, n, shard_rows)
    anchors = stage(rows.where("_anchors").drop("_anchors"), "anchors")
    parts = max(1, -(-anchors.count() // part_rows))
    held = v.copied(v.dealt(rows.drop("_anchors"), count, "_shard"), parts, "_part").drop("_row")
    asking = v.dealt(anchors, parts, "_part")
    best = stage(_positives(held, v.copied(asking, count, "_shard"), positives, dim, scale), "positives")
    packed = best.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_place", "_positive_id", "_score"))).alias("_positives"))
    chosen = v.copied(asking.join(packed, "_row"), count, "_shard")
    found = _negatives(held, chosen, positives, negatives, dim, scale, window)
    return found.select(
        F.col("_id").alias("anchor_id"), F.col("_positive_id").alias("positive_id"), F.col("_rank").alias("rank"),
        F.col("_negative_id").alias("negative_id"), F.col("_positive_score").alias("positive_score"), F.col("_score").alias("negative_score"),
    )
