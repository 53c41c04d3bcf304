"""Histories pooled and lists scored in one pass over bundles.

What a page shows is the history of the user's next pages, so a bundle of pages needs much the same vectors for both. They come
once, the user vector of each page is computed beside them, and neither is moved or written for the scores alone. A log that is
read several times is written with the user vector and the vectors of its own candidates (``stored_pages``), and read without
an exchange.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickrank.functions.dense import AdditiveWeights, PersonalizedWeights, SelfAttentionWeights, sequences, vector_array
from clickrank.operators.attention import (
    Pool,
    additive_pool,
    empty_vector,
    history_lists,
    personal_queries,
    personalized_pool,
    query_of,
    selfattn_pool,
    used_ids,
    user_vector_additive,
    user_vector_personalized,
    user_vector_selfattn,
)
from clickrank.operators.bundles import bundle_queries, bundled, each_alone, item_values, listed, match, matrix, one_array, place_columns, value_schema, with_bundle_vectors, with_queries
from clickrank.schema import EMPTY_NEWS_ID
from clickrank.session import stage

NO_VECTOR = pa.scalar(None, pa.list_(pa.float64()))


@dataclass(frozen=True)
class Additive:
    """Users by M5."""

    weights: AdditiveWeights
    history_size: int
    mask_empty: bool = False

    def table(self, behaviors: DataFrame, news_vectors: DataFrame, fits: bool | None) -> DataFrame:
        return user_vector_additive(behaviors, news_vectors, self.weights, self.history_size, self.mask_empty, fits=fits)

    def pool(self) -> tuple[Pool, int]:
        return additive_pool(self.weights), len(self.weights.w)

    def queries(self) -> DataFrame | None:
        return None


@dataclass(frozen=True)
class Personalized:
    """Users by M6; the log carries ``user_idx``."""

    weights: PersonalizedWeights
    user_vectors: DataFrame
    history_size: int
    mask_empty: bool = False

    def table(self, behaviors: DataFrame, news_vectors: DataFrame, fits: bool | None) -> DataFrame:
        return user_vector_personalized(behaviors, news_vectors, self.user_vectors, self.weights, self.history_size, self.mask_empty, fits=fits)

    def pool(self) -> tuple[Pool, int]:
        return personalized_pool, self.weights.w2.shape[1]

    def queries(self) -> DataFrame | None:
        return personal_queries(self.user_vectors, self.weights)


@dataclass(frozen=True)
class SelfAttention:
    """Users by M7."""

    weights: SelfAttentionWeights
    pooling: AdditiveWeights
    history_size: int
    mask_empty: bool = False

    def table(self, behaviors: DataFrame, news_vectors: DataFrame, fits: bool | None) -> DataFrame:
        return user_vector_selfattn(behaviors, news_vectors, self.weights, self.pooling, self.history_size, self.mask_empty, fits=fits)

    def pool(self) -> tuple[Pool, int]:
        return selfattn_pool(self.weights, self.pooling), len(self.weights.wq)

    def queries(self) -> DataFrame | None:
        return None


@dataclass(frozen=True)
class PersonalNews:
    """Users by M6 over news vectors that each user pools from segments; the log carries ``user_idx``.

    The table that is met has the vectors of all segments of a news item as ``vec``. News without segments, the padding among
    them, have the vector of the empty news (zeros unless given).
    """

    weights: PersonalizedWeights
    news_weights: PersonalizedWeights
    user_vectors: DataFrame
    history_size: int
    mask_empty: bool = False
    empty: Sequence[float] | None = None

    def pool(self) -> tuple[Pool, int]:
        return personalized_pool, self.weights.w2.shape[1]

    def queries(self) -> DataFrame:
        asked = [query_of(weights)("vec").alias(name) for name, weights in (("query", self.weights), ("news_query", self.news_weights))]
        return self.user_vectors.select("user_idx", *asked)


Users = Additive | Personalized | SelfAttention | PersonalNews


def _own_vectors(left: pa.Table, right: pa.Table, dim: int) -> tuple[pa.ChunkedArray, pa.ChunkedArray]:
    """Ids and vectors of the known news in the lists of each row, as lists: segments pooled by the user's query, once for each
    query that the user has. A user's vector of a news item is computed once for a bundle."""
    is_user = pc.is_valid(right.column("asker"))
    given, news = right.filter(is_user), right.filter(pc.invert(is_user))
    n = max(len(news), 1)
    met = [match(left.column(c), news.column("news_id")) for c in ("_history", "ids")]
    found = np.unique(np.concatenate([row[at >= 0] * n + at[at >= 0] for row, _, at in met]))
    row, at = np.divmod(found, n)
    of, _, asks = match(each_alone(one_array(left.column("user_idx"))), given.column("asker"))
    n_asks = np.bincount(of, minlength=len(left))
    times = n_asks[row]
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    row, at = np.repeat(row, times), np.repeat(at, times)
    asks = asks[(np.cumsum(n_asks) - n_asks)[row] + nth]
    pairs, pair = np.unique(np.where(asks < 0, len(given), asks) * n + at, return_inverse=True)
    asks, which = np.divmod(pairs, n)
    queries = np.vstack([matrix(given.column("news_query"), dim)[0], np.zeros((1, dim))])
    vecs = np.zeros((len(pairs), dim))
    for rows, x in sequences(one_array(news.column("vec")).take(pa.array(which))):
        vecs[rows] = personalized_pool(x, np.ones(x.shape[:2]), queries[asks[rows]])
    lists = [listed(row, len(left), values) for values in (one_array(news.column("news_id")).take(pa.array(at)), vector_array(vecs[pair]))]
    return pa.chunked_array(lists[:1]), pa.chunked_array(lists[1:])


def _pooled_rows(users: Users, behaviors: DataFrame, ids: Column, keep: Sequence[str]) -> DataFrame:
    history, filled = used_ids(F.col("history"), users.history_size, users.mask_empty)
    by_user = ["user_idx"] if users.queries() is not None else []
    columns = list(dict.fromkeys([*keep, *by_user, *place_columns(behaviors)]))
    placed = bundled(behaviors.select(*columns, history.alias("_history"), filled.alias("_filled"), ids.alias("ids")))
    return placed.select("_bundle", *dict.fromkeys([*keep, *by_user]), "_history", "_filled", "ids")


def _meet(
    users: Users, rows: DataFrame, news_vectors: DataFrame, fits: bool | None, finish, schema: str, size_of: DataFrame | None = None
) -> DataFrame:
    """``finish(rows, their user vectors, ids, vectors)`` on each bundle."""
    pool, dim = users.pool()
    own, empty = isinstance(users, PersonalNews), users.empty if isinstance(users, PersonalNews) else None
    size, masked, fill = users.history_size, users.mask_empty, np.array([empty_vector(dim, empty)])
    queries = users.queries()
    personal = queries is not None

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        asked, given = None, right
        if personal:
            left, right, asked, first = with_queries(left, right, dim)
        ids, known = _own_vectors(left, given, dim) if own else (right.column("news_id"), right.column("vec"))
        _, times, vecs = history_lists(left.column("_history"), left.column("_filled"), ids, *matrix(pc.list_flatten(known) if own else known, dim), fill, size, masked)
        pooled, there = np.zeros((len(left), dim)), np.zeros(len(left), bool)
        for rows, x, repeats in sequences(vecs, times):
            pooled[rows], there[rows] = pool(x, repeats, None if asked is None else asked[rows]), True
        if personal:  # a row without a user vector is one row, however often its user is known
            there &= np.asarray(pc.is_valid(left.column("user_idx")))
            stays = there | first
            left, pooled, there = left.filter(pa.array(stays)), pooled[stays], there[stays]
            if own:
                ids, known = ids.filter(pa.array(stays)), known.filter(pa.array(stays))
        user_vec = pa.chunked_array([pc.if_else(pa.array(there), vector_array(pooled), NO_VECTOR)])
        return finish(left, user_vec, ids, pc.list_flatten(known) if own else known)

    more = bundle_queries(rows, queries) if personal else None
    wanted = F.concat("_history", F.coalesce("ids", F.array().cast("array<string>")))
    return with_bundle_vectors(rows, news_vectors.select("news_id", "vec"), fits, work, schema, wanted, size_of, more)


def meet_pages(
    behaviors: DataFrame, ids: Column, news_vectors: DataFrame, users: Users, keep: Sequence[str], products: bool = False,
    weights: Sequence[float] | None = None, fits: bool | None = None, size_of: DataFrame | None = None,
) -> DataFrame:
    """As ``meet_users``, with user vectors that are pooled in the same pass."""
    rows = _pooled_rows(users, behaviors, ids, keep)
    kept, empty = list(keep), users.empty if isinstance(users, PersonalNews) else None

    def finish(left: pa.Table, user_vec: pa.ChunkedArray, known: pa.ChunkedArray, vecs: pa.ChunkedArray) -> pa.Table:
        return item_values(left, user_vec, known, vecs, kept, products, weights, empty)

    return _meet(users, rows, news_vectors, fits, finish, value_schema(rows, kept, products), size_of)


def page_users(
    behaviors: DataFrame, news_vectors: DataFrame, users: Users, keep: Sequence[str], fits: bool | None = None, size_of: DataFrame | None = None
) -> DataFrame:
    """``keep`` and ``user_vec`` of every row; NULL for a user whose number is, and without any item."""
    rows = _pooled_rows(users, behaviors, F.array().cast("array<string>"), keep)
    kept = list(keep)

    def finish(left: pa.Table, user_vec: pa.ChunkedArray, known: pa.ChunkedArray, vecs: pa.ChunkedArray) -> pa.Table:
        return left.select(kept).append_column("user_vec", user_vec)

    typed = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in kept)
    return _meet(users, rows, news_vectors, fits, finish, f"{typed}user_vec array<double>", size_of)


def stored_pages(behaviors: DataFrame, news_vectors: DataFrame, users: Users, keep: Sequence[str] = (), fits: bool | None = None) -> DataFrame:
    """``(impression_id, keep, impressions, user_vec, known_ids, known_vecs)``, written: every page with its user vector and the
    vectors, as stored, of its candidates and of the empty news, as far as they are known."""
    kept = list(dict.fromkeys(["impression_id", *keep, "impressions"]))
    shown = F.coalesce(F.transform("impressions", lambda x: x["news_id"]), F.array().cast("array<string>"))
    rows = _pooled_rows(users, behaviors, F.array_distinct(F.concat(shown, F.array(F.lit(EMPTY_NEWS_ID)))), kept)

    def finish(left: pa.Table, user_vec: pa.ChunkedArray, known: pa.ChunkedArray, vecs: pa.ChunkedArray) -> pa.Table:
        row, _, at = match(left.column("ids"), known)
        row, at = row[at >= 0], pa.array(at[at >= 0])
        lists = [listed(row, len(left), one_array(column).take(at)) for column in (known, vecs)]
        out = left.select(kept).append_column("user_vec", user_vec)
        return out.append_column("known_ids", pa.chunked_array(lists[:1])).append_column("known_vecs", pa.chunked_array(lists[1:]))

    typed = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    vec = news_vectors.schema["vec"].dataType.simpleString()
    schema = f"{typed}, user_vec array<double>, known_ids array<string>, known_vecs array<{vec}>"
    return stage(_meet(users, rows, news_vectors, fits, finish, schema), "pages")


def is_stored(behaviors: DataFrame) -> bool:
    return "known_vecs" in behaviors.columns


def meet_stored(
    pages: DataFrame, ids: Column, keep: Sequence[str], products: bool = False, weights: Sequence[float] | None = None
) -> DataFrame:
    """As ``meet_users``, of rows that have all they need."""
    rows = pages.select(*keep, ids.alias("ids"), "user_vec", "known_ids", "known_vecs")
    kept = list(keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = pa.Table.from_batches([batch])
            vecs = pa.chunked_array([batch.column("known_vecs").flatten()])
            yield from item_values(left, left.column("user_vec"), left.column("known_ids"), vecs, kept, products, weights, None).combine_chunks().to_batches()

    return rows.mapInArrow(work, value_schema(rows, kept, products))
