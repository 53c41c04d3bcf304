"""M6 with news vectors that depend on the user: every news item has several segment vectors, and each user weighs them.

The vector of a news item for a user is needed wherever that user meets the item, in histories and among candidates. So pages
are bundled with their neighbours by user: a bundle gets the segments of its news and the queries of its users once, and pools
the vector of each of its (user, news) pairs once (M3 over the segments), beside the histories and scores that need it. The
vectors of all pairs as a table are ``personal_news_vectors``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickrank.functions.arrays import append_empty_candidate, history_or_empty
from clickrank.functions.dense import PersonalizedWeights
from clickrank.operators.attention import empty_vector, history_key, personal_queries, pool_packed
from clickrank.operators.bundles import place_columns
from clickrank.operators.pages import PersonalNews, meet_pages, page_users
from clickrank.operators.scale import lookup
from clickrank.operators.scoring import SCORE_DECIMALS

PAIR = ["user_idx", "news_id"]


def user_news_pairs(behaviors: DataFrame, history_size: int) -> DataFrame:
    """Distinct ``(user_idx, news_id)`` of all candidates and all histories, as far as they are used.

    Repeats within a row go before anything is moved, the others are combined on the map side.
    """
    used = F.slice(history_or_empty(F.col("history")), 1, history_size)
    shown = F.transform("impressions", lambda x: x["news_id"])
    return behaviors.select("user_idx", F.explode(F.array_distinct(F.concat(used, shown))).alias("news_id")).distinct()


def segment_lists(segments: DataFrame) -> DataFrame:
    """``(news_id, vec)``: the vectors of all segments of a news item, in their order."""
    ordered = F.array_sort(F.collect_list(F.struct("segment", "vec")))
    return segments.groupBy("news_id").agg(F.transform(ordered, lambda x: x["vec"]).alias("vec"))


def personal_news_vectors(
    pairs: DataFrame,
    segments: DataFrame,
    user_vectors: DataFrame,
    weights: PersonalizedWeights,
    segment_fits: bool | None = None,
    user_fits: bool | None = None,
) -> DataFrame:
    """``(user_idx, news_id, vec)``: the segments of the news item pooled by the user's query, once per pair.

    ``segments`` has ``(news_id, segment, vec)``. A user without a vector weighs all segments alike; news without segments
    have no row, and count as the empty news wherever they are joined.
    """
    packed = segment_lists(segments).withColumnRenamed("vec", "vecs")
    queries = personal_queries(user_vectors, weights)
    asked = lookup(pairs, queries, "user_idx", size_of=user_vectors, fits=user_fits)
    none = F.array(*[F.lit(0.0)] * weights.w2.shape[1])
    joined = lookup(asked, packed, "news_id", "inner", size_of=segments, fits=segment_fits)
    filled = joined.select(
        *PAIR, F.coalesce("query", none).alias("query"), "vecs", F.transform("vecs", lambda x: F.lit(1)).alias("times")
    )
    return pool_packed(filled, PAIR, "vec")


def user_vector_personal_news(
    behaviors: DataFrame,
    segments: DataFrame,
    user_vectors: DataFrame,
    news_weights: PersonalizedWeights,
    weights: PersonalizedWeights,
    history_size: int,
    mask_empty: bool = False,
    empty: Sequence[float] | None = None,
) -> DataFrame:
    """``(user_idx, history_key, user_vec)`` as M6, over the vectors that the user's news have for this user."""
    key = history_key(F.col("history"), history_size).alias("history_key")
    near = [c for c in place_columns(behaviors) if c not in ("user_idx", "history_key")]
    histories = behaviors.select("user_idx", *near, key, "history").dropDuplicates(["user_idx", "history_key"])
    users = PersonalNews(weights, news_weights, user_vectors, history_size, mask_empty, empty)
    pooled = page_users(histories, segment_lists(segments), users, ["user_idx", "history_key"], size_of=segments)
    if not mask_empty:  # the news of a user without a number are unknown to everyone
        fill = F.array(*[F.lit(x) for x in empty_vector(weights.w2.shape[1], empty)])
        pooled = pooled.withColumn("user_vec", F.when(F.col("user_idx").isNull(), fill).otherwise(F.col("user_vec")))
    return pooled.where("user_vec is not null")


def score_personal_news(
    behaviors: DataFrame,
    segments: DataFrame,
    user_vectors: DataFrame,
    news_weights: PersonalizedWeights,
    history_weights: PersonalizedWeights,
    history_size: int = 50,
    mask_empty: bool = False,
    include_empty: bool = True,
    empty: Sequence[float] | None = None,
) -> DataFrame:
    """``scored`` rows of every candidate; ``behaviors`` carries ``user_idx``.

    Candidates without segments score as the empty news (zeros unless given).
    """
    users = PersonalNews(history_weights, news_weights, user_vectors, history_size, mask_empty, empty)
    rows = behaviors.withColumn("_shown", append_empty_candidate(F.col("impressions")) if include_empty else F.col("impressions"))
    ids = F.transform("_shown", lambda x: x["news_id"])
    met = meet_pages(rows, ids, segment_lists(segments), users, ("impression_id", "_shown"), size_of=segments)
    item = F.get("_shown", F.col("place"))
    return met.select(
        "impression_id", F.col("place").alias("pos"), item["news_id"].alias("news_id"), item["clicked"].alias("clicked"),
        F.round("value", SCORE_DECIMALS).alias("score"),
    )
