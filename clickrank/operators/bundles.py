"""Lists of news ids met with their vectors, without a vector for every item.

Rows are placed by user and cut into bundles of neighbours, whose lists overlap: a user's pages share most of their histories,
and what was shown on one page is history of the next. A bundle gets the vector of each distinct id once, as wide as it is
stored, and the arithmetic of its lists is done beside it in one task. A vector is repeated for a bundle, not for an item,
whether the vectors are broadcast to the ids or shuffled to them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickrank.functions.dense import vector_array
from clickrank.operators.scale import lookup
from clickrank.session import stage

LIST_BYTES = 8 << 20  # measured size up to which vectors are broadcast to the items of lists
BUNDLE_BITS = 8  # 256 rows: a task holds their lists and vectors at once
ITEM_BITS = 11  # 2048 rows of one item each
PLACE = ("user_id", "user_idx", "impression_id", "history_key")


def place_columns(rows: DataFrame) -> list[str]:
    return [c for c in PLACE if c in rows.columns]


def bundled(rows: DataFrame, by: Sequence[str] = (), bits: int = BUNDLE_BITS) -> DataFrame:
    """Rows with ``_bundle``, the number of neighbours by user and impression (or ``by``); written, so that numbers last."""
    by = list(by) or place_columns(rows)
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    return stage(placed.withColumn("_bundle", F.shiftright(F.monotonically_increasing_id(), bits)), "bundles")


def with_bundle_vectors(
    rows: DataFrame, vectors: DataFrame, fits: bool | None, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str,
    ids: str | Column = "ids", size_of: DataFrame | None = None, more: DataFrame | None = None,
) -> DataFrame:
    """``work`` on the rows of each bundle and the ``vectors`` of the news in their lists, and the rows of ``more`` for it."""
    pairs = rows.select(F.col("_bundle").alias("_of"), F.explode(F.array_distinct(ids)).alias("news_id")).distinct()
    met = lookup(pairs, vectors, "news_id", "inner", size_of, fits=fits)
    if more is not None:
        met = met.unionByName(more, allowMissingColumns=True)
    return rows.groupBy("_bundle").cogroup(met.groupBy("_of")).applyInArrow(work, schema)


def one_array(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def match(ids: pa.ChunkedArray, known: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in its list, place in ``known`` or -1) of every item; an id that is known twice is two items.

    Where ``known`` has lists, every row knows the ids of its own, and places are counted through all of them.
    """
    lists = one_array(ids)
    flat = lists.flatten()
    lengths = np.asarray(pc.fill_null(lists.value_lengths(), 0))
    rows = np.repeat(np.arange(len(lists)), lengths)
    own = pa.types.is_list(known.type)
    names = one_array(known).flatten() if own else one_array(known)
    distinct = pc.unique(names)
    held = np.asarray(pc.index_in(names, value_set=distinct), dtype=np.int64)
    codes = np.asarray(pc.fill_null(pc.index_in(flat, value_set=distinct, skip_nulls=True), -1), dtype=np.int64)
    if own:
        held = held + len(distinct) * np.repeat(np.arange(len(lists)), np.asarray(one_array(known).value_lengths()))
        codes = np.where(codes < 0, -1, codes + len(distinct) * rows)
    order = np.argsort(held, kind="stable")
    low, high = (np.searchsorted(held[order], codes, side) for side in ("left", "right"))
    repeats = np.maximum(high - low, 1)
    item = np.repeat(np.arange(len(flat)), repeats)
    nth = np.arange(len(item)) - np.repeat(np.cumsum(repeats) - repeats, repeats)
    found = high[item] > low[item]
    at = np.full(len(item), -1)
    at[found] = order[(low[item] + nth)[found]]
    places = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return rows[item], places[item], at


def listed(rows: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    """Values as the lists of ``n`` rows; ``rows`` ascends."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def matrix(column: pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors as doubles, is it there): zeros for a vector that is missing, not as long, or has a missing number."""
    vectors = one_array(column)
    if not dim:
        return np.zeros((len(vectors), 0)), np.zeros(len(vectors), bool)
    lengths = np.asarray(pc.fill_null(vectors.value_lengths(), 0))
    flat = vectors.flatten()
    whole = lengths == dim
    inside = np.repeat(whole, lengths)
    numbers = np.zeros((len(vectors), dim))
    numbers[whole] = np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64)[inside].reshape(-1, dim)
    if flat.null_count:
        missing = np.zeros((len(vectors), dim), bool)
        missing[whole] = np.asarray(flat.is_null())[inside].reshape(-1, dim)
        whole = whole & ~missing.any(axis=1)
        numbers[~whole] = 0.0
    return numbers, whole


def bundle_queries(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """``(_of, asker)`` and the queries of each user of a bundle, once."""
    askers = rows.select(F.col("_bundle").alias("_of"), "user_idx").where("user_idx is not null").distinct()
    return lookup(askers, queries, "user_idx", "inner", derived=True).withColumnRenamed("user_idx", "asker")


def each_alone(values: pa.Array) -> pa.ChunkedArray:
    """Every value as a list of its own."""
    return pa.chunked_array([pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1), pa.int32()), values)])


def with_queries(left: pa.Table, right: pa.Table, dim: int) -> tuple[pa.Table, pa.Table, np.ndarray, np.ndarray]:
    """(rows, once for each query of their user; the news of the bundle; the query of each row, zeros for an unknown user; is it
    the first of its row)."""
    is_user = pc.is_valid(right.column("asker"))
    given, news = right.filter(is_user), right.filter(pc.invert(is_user))
    row, _, at = match(each_alone(one_array(left.column("user_idx"))), given.column("asker"))
    queries = np.vstack([matrix(given.column("query"), dim)[0], np.zeros((1, dim))])
    return left.take(pa.array(row)), news, queries[at], np.append(True, row[1:] != row[:-1])[: len(row)]


def value_schema(rows: DataFrame, keep: Sequence[str], products: bool) -> str:
    typed = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep)
    return f"{typed}place int, value {'array<double>' if products else 'double'}"


def item_values(
    left: pa.Table, user_vec: pa.ChunkedArray, known_ids: pa.ChunkedArray, known_vecs: pa.ChunkedArray, keep: Sequence[str],
    products: bool, weights: Sequence[float] | None, empty: Sequence[float] | None,
) -> pa.Table:
    """``keep``, ``place`` and ``value`` of every item of the lists ``ids`` of ``left``; ``known_vecs`` are numbered as in ``match``."""
    dim = pc.max(pc.list_value_length(user_vec)).as_py() or 0
    users, known_user = matrix(user_vec, dim)
    if weights is not None and dim:
        users = users * np.asarray(weights, dtype=np.float64)
    vectors, known = matrix(known_vecs, dim)
    row, place, at = match(left.column("ids"), known_ids)
    filler = np.zeros((1, dim)) if empty is None or not dim else np.asarray(empty, dtype=np.float64)[None, :]
    vectors = np.vstack([vectors, filler])
    at = np.where((at >= 0) & np.append(known, False)[at], at, len(vectors) - 1)
    values = vectors[at] * users[row]
    absent = ~known_user[row]
    if products:
        listed_values = vector_array(values) if dim else pa.array([None] * len(row), pa.list_(pa.float64()))
        value = pc.if_else(pa.array(absent), pa.scalar(None, pa.list_(pa.float64())), listed_values)
    else:
        value = pa.array(values.sum(axis=1), mask=absent)
    taken = left.select(list(keep)).take(pa.array(row))
    return taken.append_column("place", pa.array(place, pa.int32())).append_column("value", value)


def meet_users(
    rows: DataFrame, ids: Column, news_vectors: DataFrame, user_vectors: DataFrame, keep: Sequence[str], products: bool = False,
    weights: Sequence[float] | None = None, empty: Sequence[float] | None = None, fits: bool | None = None,
) -> DataFrame:
    """For every item of the list ``ids`` of each row: the columns ``keep``, ``place`` in the list, and ``value``, the product
    of news and user vector or its (weighted) sum.

    Users are found by the columns of ``user_vectors`` beside ``user_vec``; without one ``value`` is NULL. Ids without a vector
    have that of the empty news (zeros unless given).
    """
    keys = [c for c in user_vectors.columns if c != "user_vec"]
    columns = list(dict.fromkeys([*keep, *keys, *place_columns(rows)]))
    placed = bundled(rows.select(*columns, ids.alias("ids"))).select("_bundle", *dict.fromkeys([*keep, *keys]), "ids")
    with_user = lookup(placed, user_vectors, keys, derived=True).select("_bundle", *keep, "ids", "user_vec")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        return item_values(left, left.column("user_vec"), right.column("news_id"), right.column("vec"), keep, products, weights, empty)

    return with_bundle_vectors(with_user, news_vectors.select("news_id", "vec"), fits, work, value_schema(with_user, keep, products))
