"""Evaluation side of a run: user vectors, scores of every candidate, metrics."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickrank.functions.arrays import append_empty_candidate
from clickrank.operators.attention import (
    AdditiveWeights,
    PersonalizedWeights,
    SelfAttentionWeights,
    attach_history_vector,
    history_key,
)
from clickrank.operators.behaviors import explode_candidates
from clickrank.operators.bundles import LIST_BYTES, meet_users
from clickrank.operators.pages import Additive, Personalized, SelfAttention, Users, is_stored, meet_pages, meet_stored
from clickrank.operators.personal_news import score_personal_news
from clickrank.operators.ranker import LinearRanker, as_linear, score_linear
from clickrank.operators.ranking import evaluate, macro_average
from clickrank.operators.scale import fits_broadcast
from clickrank.operators.scoring import SCORE_DECIMALS, score_candidates


def _scored(
    behaviors: DataFrame, news_vectors: DataFrame, users: DataFrame | Users | None, history_size: int, include_empty: bool,
    keep: tuple[str, ...], fits: bool | None, linear: LinearRanker | None = None,
) -> DataFrame:
    stored = is_stored(behaviors)
    if not stored and (fits_broadcast(news_vectors.select("news_id", "vec"), LIST_BYTES) if fits is None else fits):
        user_vectors = users if isinstance(users, DataFrame) else users.table(behaviors, news_vectors, True)
        with_user = attach_history_vector(behaviors, user_vectors, history_size)
        exploded = explode_candidates(with_user, include_empty, keep=(*keep, "user_vec"))
        return score_candidates(exploded, news_vectors, fits=True) if linear is None else score_linear(exploded, news_vectors, linear, fits=True)
    rows = behaviors.withColumn("_shown", append_empty_candidate(F.col("impressions")) if include_empty else F.col("impressions"))
    ids = F.transform("_shown", lambda x: x["news_id"])
    kept, weights = ("impression_id", *keep, "_shown"), None if linear is None else linear.coefficients
    if stored:
        met = meet_stored(rows, ids, kept, weights=weights)
    elif isinstance(users, DataFrame):
        keyed = rows.withColumn("history_key", history_key(F.col("history"), history_size))
        met = meet_users(keyed, ids, news_vectors, users, kept, weights=weights, fits=fits)
    else:
        met = meet_pages(rows, ids, news_vectors, users, kept, weights=weights, fits=fits)
    item = F.get("_shown", F.col("place"))
    score = F.col("value") if linear is None else F.col("value") + linear.intercept
    return met.select(
        "impression_id", *keep, F.col("place").alias("pos"), item["news_id"].alias("news_id"), item["clicked"].alias("clicked"),
        F.round(score, SCORE_DECIMALS).alias("score"),
    )


def score_behaviors(
    behaviors: DataFrame,
    news_vectors: DataFrame,
    user_vectors: DataFrame | Users | None,
    history_size: int,
    include_empty: bool = True,
    keep: tuple[str, ...] = (),
    fits: bool | None = None,
) -> DataFrame:
    """``scored`` rows of every candidate. User vectors are found by history (and user), one per behaviour row,
    before the candidates are unrolled, or pooled beside the scores when the way to pool them is given instead. Rows of
    ``stored_pages`` have theirs."""
    return _scored(behaviors, news_vectors, user_vectors, history_size, include_empty, keep, fits)


def evaluate_additive(
    behaviors: DataFrame,
    news_vectors: DataFrame,
    weights: AdditiveWeights,
    history_size: int = 50,
    mask_empty: bool = False,
    include_empty: bool = True,
    bounded: bool = False,
) -> DataFrame:
    """P6-P8, M5, M8, W8, A7 in one row."""
    fits = fits_broadcast(news_vectors, LIST_BYTES)
    pooled = Additive(weights, history_size, mask_empty)
    scored = score_behaviors(behaviors, news_vectors, pooled, history_size, include_empty, fits=fits)
    return macro_average(evaluate(scored, bounded))


def evaluate_personalized(
    behaviors: DataFrame,
    news_vectors: DataFrame,
    user_vectors: DataFrame,
    weights: PersonalizedWeights,
    history_size: int = 50,
    mask_empty: bool = False,
    include_empty: bool = True,
    bounded: bool = False,
) -> DataFrame:
    """As ``evaluate_additive`` with M6; ``behaviors`` carries ``user_idx``."""
    fits = fits_broadcast(news_vectors, LIST_BYTES)
    pooled = Personalized(weights, user_vectors, history_size, mask_empty)
    scored = score_behaviors(behaviors, news_vectors, pooled, history_size, include_empty, fits=fits)
    return macro_average(evaluate(scored, bounded))


def evaluate_selfattn(
    behaviors: DataFrame,
    news_vectors: DataFrame,
    weights: SelfAttentionWeights,
    pooling: AdditiveWeights,
    history_size: int = 50,
    mask_empty: bool = False,
    include_empty: bool = True,
    bounded: bool = False,
) -> DataFrame:
    """As ``evaluate_additive`` with M7."""
    fits = fits_broadcast(news_vectors, LIST_BYTES)
    pooled = SelfAttention(weights, pooling, history_size, mask_empty)
    scored = score_behaviors(behaviors, news_vectors, pooled, history_size, include_empty, fits=fits)
    return macro_average(evaluate(scored, bounded))


def evaluate_personal_news(
    behaviors: DataFrame,
    segments: DataFrame,
    user_vectors: DataFrame,
    news_weights: PersonalizedWeights,
    history_weights: PersonalizedWeights,
    history_size: int = 50,
    mask_empty: bool = False,
    include_empty: bool = True,
    bounded: bool = False,
) -> DataFrame:
    """As ``evaluate_personalized`` with news vectors that each user pools from segments."""
    scored = score_personal_news(
        behaviors, segments, user_vectors, news_weights, history_weights, history_size, mask_empty, include_empty
    )
    return macro_average(evaluate(scored, bounded))


def score_behaviors_with_ranker(
    behaviors: DataFrame,
    news_vectors: DataFrame,
    user_vectors: DataFrame | Users | None,
    ranker: LinearRanker | LogisticRegressionModel,
    history_size: int = 50,
    include_empty: bool = True,
    fits: bool | None = None,
) -> DataFrame:
    """As ``score_behaviors`` with the weighted products of M11."""
    return _scored(behaviors, news_vectors, user_vectors, history_size, include_empty, (), fits, as_linear(ranker))


def evaluate_ranker(
    behaviors: DataFrame,
    news_vectors: DataFrame,
    user_vectors: DataFrame | Users | None,
    ranker: LinearRanker | LogisticRegressionModel,
    history_size: int = 50,
    include_empty: bool = True,
    bounded: bool = False,
    fits: bool | None = None,
) -> DataFrame:
    """Every candidate scored by a trained ranker (M11) on products with the user vectors of M5, M6 or M7."""
    scored = score_behaviors_with_ranker(behaviors, news_vectors, user_vectors, ranker, history_size, include_empty, fits)
    return macro_average(evaluate(scored, bounded))
