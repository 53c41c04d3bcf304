"""Training side of a run: sampled examples and a fitted ranker."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickrank.operators.attention import AdditiveWeights, attach_history_vector, history_key
from clickrank.operators.bundles import LIST_BYTES, meet_users
from clickrank.operators.pages import Additive, Users, is_stored, meet_pages, meet_stored, stored_pages
from clickrank.operators.ranker import LinearRanker, fit_epochs, with_products
from clickrank.operators.sampling import draw_sample
from clickrank.operators.scale import fits_broadcast
from clickrank.operators.scoring import SCORE_DECIMALS, score_candidates
from clickrank.session import stage


def sampled_candidates(
    behaviors: DataFrame, npratio: int, seed: int, epoch: int = 0, keep: tuple[str, ...] = ()
) -> DataFrame:
    """The drawn candidates, one row per slot."""
    drawn = draw_sample(behaviors, npratio, seed, epoch)
    return drawn.select("impression_id", *keep, F.posexplode("sample").alias("slot", "_item")).select(
        "impression_id", *keep, "slot", "_item.news_id", "_item.clicked"
    )


def sampled_values(
    behaviors: DataFrame, news_vectors: DataFrame, users: DataFrame | Users | None, history_size: int, npratio: int, seed: int, epoch: int = 0,
    products: bool = False, fits: bool | None = None,
) -> DataFrame:
    """The drawn candidates with the ``score`` or the ``product`` of candidate and user vector (M8 and M10 of a sample)."""
    stored = is_stored(behaviors)
    if not stored and (fits_broadcast(news_vectors.select("news_id", "vec"), LIST_BYTES) if fits is None else fits):
        user_vectors = users if isinstance(users, DataFrame) else users.table(behaviors, news_vectors, True)
        drawn = sampled_candidates(attach_history_vector(behaviors, user_vectors, history_size), npratio, seed, epoch, keep=("user_vec",))
        return with_products(drawn, news_vectors, fits=True) if products else score_candidates(drawn, news_vectors, fits=True)
    sample = F.transform("sample", lambda x: F.struct(x["news_id"].alias("news_id"), x["clicked"].alias("clicked")))
    drawn = draw_sample(behaviors, npratio, seed, epoch).withColumn("sample", sample)
    ids, kept = F.transform("sample", lambda x: x["news_id"]), ("impression_id", "sample")
    if stored:
        met = meet_stored(drawn, ids, kept, products)
    elif isinstance(users, DataFrame):
        keyed = drawn.withColumn("history_key", history_key(F.col("history"), history_size))
        met = meet_users(keyed, ids, news_vectors, users, kept, products, fits=fits)
    else:
        met = meet_pages(drawn, ids, news_vectors, users, kept, products, fits=fits)
    item = F.get("sample", F.col("place"))
    value = F.col("value").alias("product") if products else F.round("value", SCORE_DECIMALS).alias("score")
    return met.select("impression_id", F.col("place").alias("slot"), item["news_id"].alias("news_id"), item["clicked"].alias("clicked"), value)


def train_ranker(
    behaviors: DataFrame,
    news_vectors: DataFrame,
    pooling: AdditiveWeights,
    npratio: int = 4,
    history_size: int = 50,
    epochs: int = 3,
    weight_decay: float = 0.0,
    seed: int = 42,
    mask_empty: bool = False,
    start: LinearRanker | None = None,
    user_vectors: DataFrame | None = None,
) -> LinearRanker:
    """The ranker learns from pooled history times candidate, element by element.

    Every epoch draws its own sample (X4 of that epoch) and starts from the weights of the one before. User vectors are
    computed once and written, with the vectors of the candidates where those are not broadcast, unless the caller has
    them (``user_vectors``, or ``behaviors`` from ``stored_pages``).
    """
    fits = None if is_stored(behaviors) else fits_broadcast(news_vectors, LIST_BYTES)
    pooled = Additive(pooling, history_size, mask_empty)
    if user_vectors is None and fits:
        user_vectors = stage(pooled.table(behaviors, news_vectors, fits), "user-vectors")
    rows = stored_pages(behaviors, news_vectors, pooled, fits=fits) if user_vectors is None and fits is False else behaviors

    def drawn(epoch: int) -> DataFrame:
        return sampled_values(rows, news_vectors, user_vectors, history_size, npratio, seed, epoch, products=True, fits=fits)

    return fit_epochs(drawn, len(pooling.w), epochs, weight_decay, start)[0]
