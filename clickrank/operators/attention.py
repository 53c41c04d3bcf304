"""M2-M7: attention pooling of news vectors into user vectors.

What depends on the news item alone (its attention logit) is computed once per distinct item, what depends on
the user alone (the query) once per user, and a user vector once per distinct history. Padded slots all hold the
same empty item, so they travel as one item with a multiplicity. ``fits`` is an earlier answer to whether the news
vectors can be broadcast; without it they are measured.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickrank.functions.arrays import history_or_empty
from clickrank.functions.dense import (
    AdditiveWeights,
    PersonalizedWeights,
    SelfAttentionWeights,
    multi_head,
    sequences,
    softmax,
    vector_array,
)
from clickrank.functions.vectors import dot
from clickrank.operators.bundles import ITEM_BITS, LIST_BYTES, bundle_queries, bundled, each_alone, listed, match, matrix, one_array, place_columns, with_bundle_vectors, with_queries
from clickrank.operators.lookup import require_keys
from clickrank.operators.scale import fits_broadcast, lookup
from clickrank.schema import EMPTY_NEWS_ID

SAFE_EXPONENT = 300.0  # exp stays finite and non-zero up to here without subtracting the largest logit

# ---------------------------------------------------------------- histories


def history_key(history: Column, history_size: int) -> Column:
    """Identifies the part of a history that is used."""
    return F.md5(F.array_join(F.slice(history_or_empty(history), 1, history_size), " "))


def distinct_histories(behaviors: DataFrame, history_size: int, *by: str) -> DataFrame:
    """One row per distinct (used) history; impressions of one user mostly share theirs."""
    used = F.slice(history_or_empty(F.col("history")), 1, history_size)
    return behaviors.select(
        *by, history_key(F.col("history"), history_size).alias("history_key"), used.alias("history")
    ).dropDuplicates([*by, "history_key"])


def history_items(histories: DataFrame, history_size: int, mask_empty: bool) -> DataFrame:
    """One row per slot with its multiplicity ``times``; all padded slots are one row, or none when masked."""
    items = F.transform("history", lambda x, i: F.struct(i.alias("slot"), x.alias("news_id"), F.lit(1).alias("times")))
    if not mask_empty:
        filled = F.size("history")
        pad = F.struct(
            filled.alias("slot"), F.lit(EMPTY_NEWS_ID).alias("news_id"), (F.lit(history_size) - filled).alias("times")
        )
        items = F.when(filled < history_size, F.concat(items, F.array(pad))).otherwise(items)
    carried = [c for c in histories.columns if c != "history"]
    return histories.select(*carried, F.inline(items))


def empty_vector(dim: int, empty: Sequence[float] | None) -> list[float]:
    """Vector of the empty news, zeros unless given."""
    return [float(x) for x in (empty if empty is not None else [0.0] * dim)]


def _item_vectors(
    items: DataFrame,
    vectors: DataFrame,
    empty: dict[str, Column],
    mask_empty: bool,
    size_of: DataFrame | None = None,
    fits: bool | None = None,
) -> DataFrame:
    """Attaches the columns of ``vectors``. Ids without a vector, the padding among them, get the values of the
    empty news, or are left out when masked."""
    if mask_empty:
        return lookup(items, vectors, "news_id", "inner", size_of, fits=fits)
    joined = lookup(items, vectors, "news_id", "left", size_of, fits=fits)
    return joined.select(*items.columns, *[F.coalesce(c, value).alias(c) for c, value in empty.items()])


def _literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


# ---------------------------------------------------------------- logits and pooling


def additive_logits(vectors: DataFrame, weights: AdditiveWeights) -> DataFrame:
    """``logit`` of every vector, once per row of the table."""
    w, b, v = weights.w, weights.b, weights.v

    @F.pandas_udf("double")
    def logit(vec: pd.Series) -> pd.Series:
        if not len(vec):
            return pd.Series([], dtype="float64")
        return pd.Series(np.tanh(np.stack(vec.to_numpy()) @ w + b) @ v)

    return vectors.withColumn("logit", logit("vec"))


def query_of(weights: PersonalizedWeights) -> Callable[[str], Column]:
    """The query of a user vector."""
    w1, b1, w2, b2 = weights.w1, weights.b1, weights.w2, weights.b2

    @F.pandas_udf("array<double>")
    def query(vec: pd.Series) -> pd.Series:
        if not len(vec):
            return pd.Series([], dtype="object")
        hidden = np.maximum(np.stack(vec.to_numpy()) @ w1 + b1, 0.0)
        return pd.Series(list(np.tanh(hidden @ w2 + b2)))

    return query


def personal_queries(user_vectors: DataFrame, weights: PersonalizedWeights) -> DataFrame:
    """``(user_idx, query)``, once per user."""
    return user_vectors.select("user_idx", query_of(weights)("vec").alias("query"))


def softmax_pool(items: DataFrame, keys: Sequence[str], logit_bound: float, name: str = "pooled") -> DataFrame:
    """Softmax-weighted mean of ``vec`` per group, from ``logit`` and ``times``.

    The weighted mean combines on the map side, so rows of one group that sit together leave as one vector and
    a group of any size is no burden for a task. Logits that are known to be moderate need no maximum; beyond
    that the maximum per group is joined in, from an aggregate that combines on the map side as well.
    """
    if logit_bound <= SAFE_EXPONENT:
        weighted = items.withColumn("_w", F.col("times") * F.exp("logit"))
    else:
        largest = items.groupBy(*keys).agg(F.max("logit").alias("_max"))
        weighted = lookup(items, largest, list(keys), derived=True).withColumn("_w", F.col("times") * F.exp(F.col("logit") - F.col("_max")))
    vec = F.col("vec")
    packed = isinstance(items.schema["vec"].dataType, VectorUDT)
    mean = Summarizer.mean(vec if packed else array_to_vector(vec), F.col("_w"))
    return weighted.groupBy(*keys).agg(vector_to_array(mean).alias(name))


def additive_attention_pool(
    items: DataFrame, keys: Sequence[str], vectors: DataFrame, weights: AdditiveWeights, name: str = "pooled",
    empty: Sequence[float] | None = None, strict: bool = False, fits: bool | None = None,
) -> DataFrame:
    """M2: pools the vectors of each group's items; ``items`` has the keys and ``news_id``.

    Unknown news count as the empty news (zeros unless given), so that no item and no group is lost; ``strict`` raises.
    """
    vectors = vectors.select("news_id", "vec")
    if strict:
        require_keys(items, vectors, "news_id")
    vec = empty_vector(len(weights.w), empty)
    fill = float(np.tanh(np.asarray(vec) @ weights.w + weights.b) @ weights.v)
    joined = lookup(items.withColumn("times", F.lit(1)), additive_logits(vectors, weights), "news_id", size_of=vectors, fits=fits)
    filled = joined.withColumns({"vec": F.coalesce("vec", _literal(vec)), "logit": F.coalesce("logit", F.lit(fill))})
    return softmax_pool(filled, keys, float(np.abs(weights.v).sum()), name)


def _l1_bound(vectors: DataFrame) -> float:
    """Largest possible |x . query|, as query components are within [-1, 1]."""
    size = F.aggregate(F.transform("vec", F.abs), F.lit(0.0), lambda a, x: a + x)
    return float(vectors.agg(F.max(size)).first()[0] or 0.0)


def _bundle_means(items: DataFrame, keys: Sequence[str], vectors: DataFrame, queries: DataFrame, empty: Sequence[float]) -> DataFrame:
    """Items of each group and bundle as one: the pooled ``vec``, and the ``logit`` that weighs as much as all of them.

    A bundle gets the vector of each distinct news item and the query of each user once. Groups may go on in other bundles.
    """
    by = list(dict.fromkeys(["user_idx", *keys]))
    rows = bundled(items.select(*dict.fromkeys([*by, "news_id"])), by, ITEM_BITS)
    named, fill = list(keys), np.array([empty])

    def pool(left: pa.Table, right: pa.Table) -> pa.Table:
        left, news, asked, _ = with_queries(left, right, fill.shape[1])
        vectors, known = matrix(news.column("vec"), fill.shape[1])
        row, _, at = match(each_alone(one_array(left.column("news_id"))), news.column("news_id"))
        x = np.vstack([np.where(known[:, None], vectors, fill), fill])[at]
        logits = (x * asked[row]).sum(axis=1)
        group = np.zeros(len(left), dtype=np.int64)
        for key in named:
            codes = one_array(left.column(key)).dictionary_encode(null_encoding="encode").indices
            group = np.unique(group * len(left) + np.asarray(codes), return_inverse=True)[1]
        firsts = np.unique(group, return_index=True)[1]
        order = np.argsort(group[row], kind="stable")
        starts = np.searchsorted(group[row][order], np.arange(len(firsts)))
        most = np.maximum.reduceat(logits[order], starts)
        share = np.exp(logits - most[group[row]])
        total = np.add.reduceat(share[order], starts)
        mean = np.add.reduceat((share[:, None] * x)[order], starts, axis=0) / total[:, None]
        out = left.select(named).take(pa.array(firsts))
        out = out.append_column("times", pa.array(np.ones(len(firsts)), pa.int32()))
        return out.append_column("logit", pa.array(most + np.log(total))).append_column("vec", vector_array(mean))

    typed = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in named)
    schema = f"{typed}times int, logit double, vec array<double>"
    return with_bundle_vectors(rows, vectors.select("news_id", "vec"), False, pool, schema, F.array("news_id"), more=bundle_queries(rows, queries))


def personalized_attention_pool(
    items: DataFrame,
    keys: Sequence[str],
    vectors: DataFrame,
    user_vectors: DataFrame,
    weights: PersonalizedWeights,
    name: str = "pooled",
    empty: Sequence[float] | None = None,
    strict: bool = False,
    fits: bool | None = None,
    user_fits: bool | None = None,
) -> DataFrame:
    """M3: as M2, with logits from the user's query; ``items`` has the keys, ``news_id`` and ``user_idx``.

    A user without a vector asks with zeros, which weighs all items alike; ``strict`` raises for users and news.
    """
    if strict:
        require_keys(items, user_vectors, "user_idx")
        require_keys(items, vectors, "news_id")
    vec = empty_vector(weights.w2.shape[1], empty)
    queries = personal_queries(user_vectors, weights)
    fits = fits_broadcast(vectors.select("news_id", "vec")) if fits is None else fits
    if not fits:
        bound = max(_l1_bound(vectors), float(np.abs(vec).sum()))
        return softmax_pool(_bundle_means(items, keys, vectors, queries, vec), keys, bound, name)
    asked = lookup(items.withColumn("times", F.lit(1)), queries, "user_idx", size_of=user_vectors, fits=user_fits)
    joined = lookup(asked, vectors.select("news_id", "vec"), "news_id", fits=fits)
    filled = joined.withColumns({"vec": F.coalesce("vec", _literal(vec)), "query": F.coalesce("query", _literal([0.0] * len(vec)))})
    bound = max(_l1_bound(vectors), float(np.abs(vec).sum()))
    return softmax_pool(filled.withColumn("logit", dot(F.col("vec"), F.col("query"))), keys, bound, name)


def packed_items(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items of each group as parallel arrays, in any order; at most history_size of them."""
    fields = [c for c in ("slot", "times", "logit", "vec") if c in items.columns]
    plural = {"slot": "slots", "times": "times", "logit": "logits", "vec": "vecs"}
    return items.groupBy(*keys).agg(*[F.collect_list(f).alias(plural[f]) for f in fields])


def pool_packed(packed: DataFrame, keys: Sequence[str], name: str = "user_vec") -> DataFrame:
    """Softmax pooling of packed items, by their logits or by the query of their user.

    A history has at most history_size items, so a batch of them is dense arithmetic. Histories were made
    distinct by ``keys``; where the vectors are broadcast, their items lie together and packing moves nothing.
    """
    asked = "query" in packed.columns

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [batch.column("times")] + ([] if asked else [batch.column("logits")])
            if asked:
                queries = np.asarray(batch.column("query").flatten()).reshape(len(batch), -1)
            for rows, x, repeats, *given in sequences(batch.column("vecs"), *numbers):
                logits = np.einsum("bnd,bd->bn", x, queries[rows]) if asked else given[0]
                pooled = np.einsum("bn,bnd->bd", softmax(logits, repeats), x)
                named = [batch.column(k).take(pa.array(rows)) for k in keys]
                yield pa.RecordBatch.from_arrays([*named, vector_array(pooled)], names=[*keys, name])

    keyed = ", ".join(f"{k} {packed.schema[k].dataType.simpleString()}" for k in keys)
    return packed.mapInArrow(pool, f"{keyed}, {name} array<double>")


# Arithmetic on (batch, items, dim), multiplicities, and the query of each sequence where there is one.
Pool = Callable[[np.ndarray, np.ndarray, "np.ndarray | None"], np.ndarray]


def additive_pool(weights: AdditiveWeights) -> Pool:
    def pool(x: np.ndarray, repeats: np.ndarray, asked: np.ndarray | None) -> np.ndarray:
        logits = np.tanh(x @ weights.w + weights.b) @ weights.v
        return np.einsum("bn,bnd->bd", softmax(logits, repeats), x)

    return pool


def personalized_pool(x: np.ndarray, repeats: np.ndarray, asked: np.ndarray | None) -> np.ndarray:
    return np.einsum("bn,bnd->bd", softmax(np.einsum("bnd,bd->bn", x, asked), repeats), x)


def selfattn_pool(weights: SelfAttentionWeights, pooling: AdditiveWeights) -> Pool:
    pooled = additive_pool(pooling)
    return lambda x, repeats, asked: pooled(multi_head(x, repeats, weights), repeats, None)


def _pools(pool: Pool, keys: Sequence[str], asked: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``keys`` and ``user_vec`` of packed histories."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            queries = np.asarray(batch.column("query").flatten()).reshape(len(batch), -1) if asked else None
            for rows, x, repeats in sequences(batch.column("vecs"), batch.column("times")):
                pooled = pool(x, repeats, None if queries is None else queries[rows])
                named = [batch.column(k).take(pa.array(rows)) for k in keys]
                yield pa.RecordBatch.from_arrays([*named, vector_array(pooled)], names=[*keys, "user_vec"])

    return work


def used_ids(history: Column, history_size: int, mask_empty: bool) -> tuple[Column, Column]:
    """(ids of the used part of a history, with one empty news if slots are left; number of used slots)."""
    used = F.slice(history_or_empty(history), 1, history_size)
    padded = F.when(F.size(used) < history_size, F.concat(used, F.array(F.lit(EMPTY_NEWS_ID)))).otherwise(used)
    return used if mask_empty else padded, F.size(used)


def history_lists(
    ids: pa.ChunkedArray, filled: pa.ChunkedArray, known_ids: pa.ChunkedArray, vectors: np.ndarray, known: np.ndarray,
    fill: np.ndarray, history_size: int, mask_empty: bool,
) -> tuple[pa.ListArray, pa.ListArray, pa.ListArray]:
    """``slots``, ``times`` and ``vecs`` of each list of ids, from the vectors of a bundle."""
    row, place, at = match(ids, known_ids)
    vectors = np.vstack([np.where(known[:, None], vectors, fill), fill])
    if mask_empty:
        row, place, at = row[at >= 0], place[at >= 0], at[at >= 0]
    times = np.where(place < np.asarray(filled)[row], 1, history_size - np.asarray(filled)[row])
    lists = [pa.array(place, pa.int32()), pa.array(times, pa.int32()), vector_array(vectors[at])]
    return tuple(listed(row, len(ids), values) for values in lists)


def per_history(
    behaviors: DataFrame,
    news_vectors: DataFrame,
    work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str,
    names: dict[str, pa.DataType],
    dim: int,
    history_size: int,
    mask_empty: bool,
    empty: Sequence[float] | None,
    fits: bool | None,
    by: Sequence[str] = (),
    queries: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """``work`` on batches of distinct histories packed with their ``slots``, ``times`` and ``vecs``.

    Vectors of up to ``LIST_BYTES`` are broadcast to the items, which move nothing. Otherwise histories are bundled with
    their neighbours, so that a vector comes once for all pages of a user that have it.
    """
    plain = news_vectors.select("news_id", "vec")
    if fits_broadcast(plain, LIST_BYTES) if fits is None else fits:
        items = history_items(distinct_histories(behaviors, history_size, *by), history_size, mask_empty)
        joined = _item_vectors(items, plain, {"vec": _literal(empty_vector(dim, empty))}, mask_empty, fits=True)
        return queries(packed_items(joined, [*by, "history_key"])).mapInArrow(work, schema)
    ids, filled = used_ids(F.col("history"), history_size, mask_empty)
    near = [c for c in place_columns(behaviors) if c not in (*by, "history_key")]
    histories = behaviors.select(
        *by, *near, history_key(F.col("history"), history_size).alias("history_key"), ids.alias("ids"), filled.alias("filled")
    ).dropDuplicates([*by, "history_key"])
    rows = queries(bundled(histories).drop(*near))
    fill = np.array([empty_vector(dim, empty)])
    carried = [*by, "history_key", *(["query"] if "query" in rows.columns else [])]

    def pack(left: pa.Table, right: pa.Table) -> pa.Table:
        lists = history_lists(
            left.column("ids"), left.column("filled"), right.column("news_id"), *matrix(right.column("vec"), dim), fill, history_size, mask_empty
        )
        batch = pa.RecordBatch.from_arrays(
            [*[left.column(c).combine_chunks() for c in carried], *lists],
            names=[*carried, "slots", "times", "vecs"],
        )
        return pa.Table.from_batches(list(work(iter([batch]))), schema=pa.schema([(c, batch.schema.field(c).type if c in carried else t) for c, t in names.items()]))

    return with_bundle_vectors(rows, plain, fits, pack, schema)


_VECTOR = pa.list_(pa.field("item", pa.float64()))


def user_vector_additive(
    behaviors: DataFrame,
    news_vectors: DataFrame,
    weights: AdditiveWeights,
    history_size: int,
    mask_empty: bool = False,
    empty: Sequence[float] | None = None,
    fits: bool | None = None,
) -> DataFrame:
    """M5: ``(history_key, user_vec)`` by additive attention over the history."""

    return per_history(
        behaviors, news_vectors, _pools(additive_pool(weights), ["history_key"]), "history_key string, user_vec array<double>", {"history_key": pa.string(), "user_vec": _VECTOR},
        len(weights.w), history_size, mask_empty, empty, fits,
    )


def user_vector_personalized(
    behaviors: DataFrame,
    news_vectors: DataFrame,
    user_vectors: DataFrame,
    weights: PersonalizedWeights,
    history_size: int,
    mask_empty: bool = False,
    empty: Sequence[float] | None = None,
    fits: bool | None = None,
    user_fits: bool | None = None,
) -> DataFrame:
    """M6: ``(user_idx, history_key, user_vec)``; ``behaviors`` carries ``user_idx``. Unknown users as in M3."""
    none = _literal([0.0] * weights.w2.shape[1])

    def queries(rows: DataFrame) -> DataFrame:
        asked = lookup(rows, personal_queries(user_vectors, weights), "user_idx", size_of=user_vectors, fits=user_fits)
        return asked.withColumn("query", F.coalesce("query", none))

    kind = behaviors.schema["user_idx"].dataType.simpleString()
    return per_history(
        behaviors, news_vectors, _pools(personalized_pool, ["user_idx", "history_key"], asked=True), f"user_idx {kind}, history_key string, user_vec array<double>",
        {"user_idx": pa.int64(), "history_key": pa.string(), "user_vec": _VECTOR},
        weights.w2.shape[1], history_size, mask_empty, empty, fits, ("user_idx",), queries,
    )


def self_attention(
    behaviors: DataFrame,
    news_vectors: DataFrame,
    weights: SelfAttentionWeights,
    history_size: int,
    mask_empty: bool = False,
    empty: Sequence[float] | None = None,
    fits: bool | None = None,
) -> DataFrame:
    """M4: ``(history_key, slot, times, vec)``, every history item after attention to the whole history."""

    def attend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, slots, times = batch.column("history_key"), batch.column("slots"), batch.column("times")
            for rows, x, repeats in sequences(batch.column("vecs"), times):
                out = multi_head(x, repeats, weights)
                n, dim = out.shape[1:]
                taken = pa.array(rows)
                vectors = vector_array(out.reshape(-1, dim))
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(np.repeat(rows, n))), slots.take(taken).flatten(), times.take(taken).flatten(), vectors],
                    names=["history_key", "slot", "times", "vec"],
                )

    return per_history(
        behaviors, news_vectors, attend, "history_key string, slot int, times int, vec array<double>",
        {"history_key": pa.string(), "slot": pa.int32(), "times": pa.int32(), "vec": _VECTOR},
        len(weights.wq), history_size, mask_empty, empty, fits,
    )


def user_vector_selfattn(
    behaviors: DataFrame,
    news_vectors: DataFrame,
    weights: SelfAttentionWeights,
    pooling: AdditiveWeights,
    history_size: int,
    mask_empty: bool = False,
    empty: Sequence[float] | None = None,
    fits: bool | None = None,
) -> DataFrame:
    """M7: ``(history_key, user_vec)``; self-attention and additive pooling of a history in one pass."""

    return per_history(
        behaviors, news_vectors, _pools(selfattn_pool(weights, pooling), ["history_key"]), "history_key string, user_vec array<double>", {"history_key": pa.string(), "user_vec": _VECTOR},
        len(weights.wq), history_size, mask_empty, empty, fits,
    )


def attach_history_vector(rows: DataFrame, vectors: DataFrame, history_size: int) -> DataFrame:
    """``user_vec`` of each behaviour row by its history (and user, if the vectors are per user)."""
    keys = [c for c in vectors.columns if c != "user_vec"]
    keyed = rows.withColumn("history_key", history_key(F.col("history"), history_size))
    return lookup(keyed, vectors, keys, derived=True)
