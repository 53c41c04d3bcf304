"""Exact top-k by inner product: a KD-tree per shard, searched best-first with the k-th score handed on.

``build_index`` deals the rows to equal shards by row number and writes one tree per shard: median splits along the
widest dimension, boxes that are tight around the rows, leaves of ``leaf_rows`` rows or up to twice as many. ``search`` lets every query
visit one shard first, then about the square root of their number, then the rest; each round starts from the k-th score
of the rounds before. In a tree a query descends level by level into the boxes whose bound, the largest inner product
that any point of the box could have, reaches its k-th score, and takes the leaves that are left best bound first, in
waves of 1, 2, 4, ... of them; a wave raises the bar for the next. Only boxes whose bound is below the k-th score are
left out, so the answer is exact, and at most about twice the leaves are read that one-by-one order would read. On
vectors without structure the bounds cut little and most leaves are read.

Memory of a task: one tree and ``PART_ROWS`` queries or so. Trees are copied once per part of queries, queries once per
shard; nothing is collected or broadcast.

Defined cases: rows without an id, and vectors that are null or hold null or non-finite components, take no part, neither
as queries nor as candidates; vectors of unequal length are filled up with zeros; an empty vector scores 0. Ties go to the
smaller id. A query's own id is no candidate of it, however often it is there; other rows that repeat are candidates each,
and a query row that repeats is answered as often. Equal vectors are dealt over all shards. Fewer than k candidates
are all returned; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickrank.llm import vectors as v
from clickrank.session import stage

LEAF_ROWS = 512
_LEAST = np.iinfo(np.int64).min


# ---------------------------------------------------------------- one tree


def halves(n: int, depth: int) -> list[np.ndarray]:
    """Per level the borders of its nodes, which are halved from level to level."""
    levels = [np.array([0, n])]
    for _ in range(depth):
        at = levels[-1]
        middle = (at[:-1] + at[1:]) // 2
        levels.append(np.append(np.column_stack([at[:-1], middle]).ravel(), n))
    return levels


def depth_of(n: int, leaf_rows: int) -> int:
    return max(0, int(np.floor(np.log2(max(1, n) / leaf_rows))))


def build_tree(x: np.ndarray, leaf_rows: int = LEAF_ROWS) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(order of the rows, least corners per level, largest corners per level)."""
    order, depth = np.arange(len(x)), depth_of(len(x), leaf_rows)
    levels = halves(len(x), depth)
    low, high = [], []
    for level, at in enumerate(levels):
        lo, hi = np.empty((len(at) - 1, x.shape[1]), np.int64), np.empty((len(at) - 1, x.shape[1]), np.int64)
        for node, (a, b) in enumerate(zip(at[:-1], at[1:])):
            rows = x[order[a:b]]
            lo[node], hi[node] = rows.min(axis=0), rows.max(axis=0)
            if level < depth and x.shape[1]:
                widest = int(np.argmax(hi[node] - lo[node]))
                order[a:b] = order[a:b][np.argpartition(rows[:, widest], (b - a) // 2)]
        low.append(lo)
        high.append(hi)
    return order, low, high


def bounds(up: np.ndarray, down: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Largest inner product of each query (its positive and negative parts) with any point of each box."""
    return v.product(up, hi.T) + v.product(down, lo.T)


def search_tree(
    queries: np.ndarray, own: np.ndarray, bar: np.ndarray, k: int,
    x: np.ndarray, ids: np.ndarray, low: list[np.ndarray], high: list[np.ndarray],
) -> v.Heaps:
    """The best rows of one tree for each query, none below its ``bar``; rows of the id ``own`` are left out."""
    heaps = v.Heaps(len(queries), k)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    alive = np.ones((len(queries), 1), bool)
    for lo, hi in zip(low, high):
        if len(lo) > alive.shape[1]:
            alive = np.repeat(alive, 2, axis=1)
        wanted = np.flatnonzero(alive.any(axis=0))
        reach = np.full(alive.shape, _LEAST)
        reach[:, wanted] = bounds(up, down, lo[wanted], hi[wanted])
        alive &= reach >= bar[:, None]
    at = halves(len(x), len(low) - 1)[-1]
    reach[~alive] = _LEAST
    best = np.argsort(-reach.astype(np.float64), axis=1, kind="stable")
    left = alive.sum(axis=1)
    begin, width = 0, 1
    while begin < best.shape[1] and (left > begin).any():
        # The bar of a query is the better of the k-th score handed in and its k-th score here.
        now = np.maximum(bar, heaps.bar())
        wave = best[:, begin : begin + width]
        place = np.arange(begin, begin + wave.shape[1])[None, :]
        ahead = (place < left[:, None]) & (np.take_along_axis(reach, wave, axis=1) >= now[:, None])
        asking, column = np.nonzero(ahead)
        leaves = wave[asking, column]
        grouped = np.argsort(leaves, kind="stable")
        cuts = np.flatnonzero(np.diff(leaves[grouped])) + 1
        for part in np.split(grouped, cuts):
            if len(part):
                leaf, rows = leaves[part[0]], asking[part]
                a, b = at[leaf], at[leaf + 1]
                scores = v.product(queries[rows], x[a:b].T)
                floor = np.maximum(bar[rows], heaps.bar()[rows])
                hit, where = np.nonzero((scores >= floor[:, None]) & (ids[a:b][None, :] != own[rows][:, None]))
                heaps.offer(rows[hit], scores[hit, where], ids[a:b][where])
        begin, width = begin + width, 2 * width
    return heaps


# ---------------------------------------------------------------- the index


def _narrow(x: np.ndarray) -> np.ndarray:
    """The smallest whole type that holds the numbers."""
    size = v.largest(x)
    return x.astype(np.int16 if size < 1 << 15 else np.int32 if size < 1 << 31 else np.int64)


def _binary(x: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes()], pa.binary())


def build_index(rows: DataFrame, shards: int, dim: int, scale: float, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """One written row per shard: its tree, with the vectors in the smallest type that holds them."""

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        x = v.integers(table.column("_vec"), scale, dim)
        order, low, high = build_tree(x, leaf_rows)
        ids = np.asarray(table.column("_id")).astype(np.int64)[order]
        packed, corners = _narrow(x[order]), _narrow(np.concatenate(low + high))
        return pa.table({
            "_shard": pa.array([key[0].as_py()], pa.int32()), "_n": pa.array([len(x)], pa.int64()),
            "_depth": pa.array([len(low) - 1], pa.int32()),
            "_kind": pa.array([packed.dtype.str]), "_x": _binary(packed), "_ids": _binary(ids),
            "_corner_kind": pa.array([corners.dtype.str]), "_corners": _binary(corners),
        })

    schema = "_shard int, _n long, _depth int, _kind string, _x binary, _ids binary, _corner_kind string, _corners binary"
    return stage(v.dealt(rows, shards, "_shard").groupBy("_shard").applyInArrow(build, schema), "trees")


def _opened(tree: dict, dim: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    n, depth = tree["_n"], tree["_depth"]
    x = np.frombuffer(tree["_x"], tree["_kind"]).astype(np.int64).reshape(n, dim)
    sizes = [1 << level for level in range(depth + 1)]
    corners = np.frombuffer(tree["_corners"], tree["_corner_kind"]).astype(np.int64).reshape(2 * sum(sizes), dim)
    cut = np.split(corners, np.cumsum(sizes + sizes)[:-1])
    return x, np.frombuffer(tree["_ids"], np.int64), cut[: depth + 1], cut[depth + 1 :]


def _round(index: DataFrame, queries: DataFrame, first: int, end: int, shards: int, parts: int, k: int, dim: int, scale: float) -> DataFrame:
    """Queries in the shards ``first`` to ``end`` from their own on; ``_bar`` is their k-th score so far or null."""
    steps = F.explode(F.sequence(F.lit(first), F.lit(end - 1)))
    asked = queries.withColumn("_step", steps).withColumn("_shard", F.pmod(F.col("_home") + F.col("_step"), F.lit(shards)).cast("int"))

    def look(asked: pa.Table, trees: pa.Table) -> pa.Table:
        found = {"_row": [], "_id": [], "_vec_id": [], "_score": []}
        if asked.num_rows and trees.num_rows:
            x, ids, low, high = _opened(trees.to_pylist()[0], dim)
            rows, own = (np.asarray(asked.column(c)).astype(np.int64) for c in ("_row", "_id"))
            bar = np.asarray(asked.column("_bar").fill_null(int(_LEAST))).astype(np.int64)
            wanted = v.integers(asked.column("_vec"), scale, dim)
            v.require_fit(wanted, x)
            for a in range(0, len(rows), 1024):
                part = slice(a, a + 1024)
                heaps = search_tree(wanted[part], own[part], bar[part], k, x, ids, low, high)
                which, scores, hits = heaps.entries()
                for name, values in zip(found, (rows[part][which], own[part][which], hits, scores)):
                    found[name].append(values)
        return pa.table({n: pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for n, c in found.items()})

    keys = ["_shard", "_part"]
    narrow = asked.select(*keys, "_row", "_id", "_vec", "_bar")
    trees = v.copied(index, parts, "_part")
    joined = narrow.groupBy(*keys).cogroup(trees.groupBy(*keys))
    return joined.applyInArrow(look, "_row long, _id long, _vec_id long, _score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("_row").orderBy(F.desc("_score"), "_vec_id")
    return found.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)


def top_k(
    df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 1024,
    shard_rows: int = v.SHARD_ROWS, leaf_rows: int = LEAF_ROWS, part_rows: int = v.PART_ROWS,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best other rows of every row that ``is_query`` names."""
    rows = v.usable_rows(df, id_col, vec_col, _asks=F.coalesce(is_query, F.lit(False)))
    n, dim = v.shape(rows)
    shards = v.shard_count(rows, n, shard_rows)
    asking = rows.where("_asks").drop("_asks")
    parts = max(1, -(-asking.count() // part_rows))
    index = build_index(rows, shards, dim, scale, leaf_rows)
    # A query starts in a shard of its own choice, so that the first round is dealt evenly too.
    home = F.pmod(F.xxhash64("_row", F.lit("home")), F.lit(shards)).cast("int")
    queries = v.dealt(asking, parts, "_part").withColumn("_home", home)
    borders = sorted({0, 1, 1 + int(np.sqrt(shards)) if shards > 8 else 1, shards})
    best = None
    for first, end in zip(borders[:-1], borders[1:]):
        if best is None:
            asked = queries.withColumn("_bar", F.lit(None).cast("long"))
        else:
            bars = best.where(F.col("_rank") == k).select("_row", F.col("_score").alias("_bar"))
            asked = queries.join(bars, "_row", "left")
        found = _round(index, asked, first, end, shards, parts, k, dim, scale)
        if best is not None:
            found = found.unionByName(best.drop("_rank"))
        best = _best(found, k) if end == shards else stage(_best(found, k), "best")
    return best.select(F.col("_id").alias("query_id"), F.col("_rank").alias("rank"), F.col("_vec_id").alias("vec_id"), F.col("_score").alias("score"))
