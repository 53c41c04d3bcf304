"""News vectors, candidate scores, the sampled loss and a trained click ranker."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickrank.functions.tokens import tokens
from clickrank.functions.vectors import dot, product
from clickrank.operators.scale import lookup

SCORE_DECIMALS = 9  # summation order must not decide between equal scores


def encode_news(
    news_text: DataFrame, encode_fn: Callable[[pd.DataFrame], np.ndarray] | None = None, dim: int = 256
) -> DataFrame:
    """M1: ``(news_id, vec)``, each news item encoded once.

    ``encode_fn`` gets the text columns of a batch and returns one row of numbers per news item; it runs in the
    tasks on Arrow batches. Without it the vector is the hashed TF-IDF of all text columns.
    """
    texts = [c for c in news_text.columns if c != "news_id"]
    if encode_fn is None:
        words = news_text.select("news_id", tokens(F.concat_ws(" ", *texts)).alias("words"))
        stages = [HashingTF(inputCol="words", outputCol="tf", numFeatures=dim), IDF(inputCol="tf", outputCol="tfidf")]
        fitted = Pipeline(stages=stages).fit(words)
        return fitted.transform(words).select("news_id", vector_to_array("tfidf").alias("vec"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = np.asarray(encode_fn(batch[texts]), dtype=np.float64)
            yield pd.DataFrame({"news_id": batch["news_id"], "vec": list(vectors)})

    return news_text.mapInPandas(encode, "news_id string, vec array<double>")


def score_candidates(
    candidates: DataFrame,
    news_vectors: DataFrame,
    user_vectors: DataFrame | None = None,
    empty: Sequence[float] | None = None,
    fits: bool | None = None,
) -> DataFrame:
    """M8: ``score``, the dot product of candidate and user vector.

    The user vector is the column ``user_vec``, or is looked up in ``user_vectors`` by its other columns; without
    one the score is NULL. Ids without a vector score as the empty news (zeros unless given). The vectors are
    dropped once the score is there, so what is shuffled next is narrow.
    """
    rows = candidates
    if user_vectors is not None:
        rows = lookup(rows, user_vectors, [c for c in user_vectors.columns if c != "user_vec"], derived=True)
    joined = lookup(rows, news_vectors.select("news_id", "vec"), "news_id", fits=fits)
    kept = [c for c in rows.columns if c != "user_vec"]
    user = F.col("user_vec")
    fallback = F.lit(0.0) if empty is None else dot(F.array(*[F.lit(float(x)) for x in empty]), user)
    score = F.when(user.isNotNull(), F.coalesce(dot(F.col("vec"), user), fallback))
    return joined.select(*kept, F.round(score, SCORE_DECIMALS).alias("score"))


def listwise_loss(sampled_scores: DataFrame, keys: Sequence[str] = ("impression_id",)) -> DataFrame:
    """M9: mean cross-entropy of the scores of each sample against its clicked slot.

    Three mergeable aggregates per sample: the largest score gives the stable shift in a second aggregate over
    the at most ``1 + npratio`` collected scores.
    """
    per_sample = sampled_scores.groupBy(*keys).agg(
        F.collect_list("score").alias("scores"),
        F.max(F.when(F.col("clicked") == 1, F.col("score"))).alias("target"),
    )
    top = F.array_max("scores")
    mass = F.aggregate("scores", F.lit(0.0), lambda a, s: a + F.exp(s - top))
    return per_sample.select((F.log(mass) + top - F.col("target")).alias("loss")).agg(
        F.count("loss").alias("samples"), F.avg("loss").alias("loss")
    )


def ranker_features(
    candidates: DataFrame, news_vectors: DataFrame, empty: Sequence[float] | None = None, fits: bool | None = None
) -> DataFrame:
    """Element-wise product of candidate and user vector as ``features``.

    Fillers and other ids without a vector have that of the empty news (zeros unless given). Without a user vector the
    features are zeros and ``known_user`` is false: such rows are not trained on and have no score.
    """
    joined = lookup(candidates, news_vectors.select("news_id", "vec"), "news_id", fits=fits)
    kept = [c for c in candidates.columns if c != "user_vec"]
    user = F.col("user_vec")
    length = F.coalesce(F.size("vec"), F.size("user_vec"), F.lit(0))
    none = F.array_repeat(F.lit(0.0), F.greatest(F.when(user.isNotNull(), F.size(user)).otherwise(length), F.lit(0)))
    vec = F.coalesce("vec", none if empty is None else F.array(*[F.lit(float(x)) for x in empty]))
    return joined.select(
        *kept, user.isNotNull().alias("known_user"),
        array_to_vector(F.when(user.isNotNull(), product(vec, user)).otherwise(none)).alias("features"),
    )


def fit_ranker(features: DataFrame, epochs: int = 3, weight_decay: float = 0.0, tolerance: float = 1e-6) -> LogisticRegressionModel:
    """A click ranker on sampled candidates; every pass is a distributed aggregation of gradients."""
    if "known_user" in features.columns:
        features = features.where("known_user")
    labelled = features.select("features", F.col("clicked").cast("double").alias("label"))
    return LogisticRegression(maxIter=epochs, regParam=weight_decay, tol=tolerance).fit(labelled)


def save_ranker(model: LogisticRegressionModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_ranker(path: str) -> LogisticRegressionModel:
    return LogisticRegressionModel.load(path)


def score_with_ranker(features: DataFrame, model: LogisticRegressionModel) -> DataFrame:
    """``score`` of every candidate by a trained ranker; several may be clicked. NULL without a user vector."""
    scored = model.transform(features)
    kept = [c for c in features.columns if c not in ("features", "known_user")]
    score = F.round(vector_to_array("rawPrediction")[1], SCORE_DECIMALS)
    known = F.col("known_user") if "known_user" in features.columns else F.lit(True)
    return scored.select(*kept, F.when(known, score).alias("score"))
