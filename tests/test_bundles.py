"""Vectors that are not broadcast come once for a bundle of lists, and the rows are the same as by broadcast."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickrank.operators import attention as att
from clickrank.operators import bundles
from clickrank.operators.ranker import LinearRanker
from clickrank.plans.evaluation import score_behaviors, score_behaviors_with_ranker
from clickrank.plans.training import sampled_values

rng = np.random.default_rng(3)
DIM, SIZE = 4, 6
ADDITIVE = att.AdditiveWeights(rng.normal(size=(DIM, 3)), rng.normal(size=3), rng.normal(size=3))
PERSONAL = att.PersonalizedWeights(rng.normal(size=(DIM, 3)), rng.normal(size=3), rng.normal(size=(3, DIM)), rng.normal(size=DIM))
SELF = att.SelfAttentionWeights(*[rng.normal(size=(DIM, DIM)) for _ in range(4)], heads=2)
SCHEMA = "impression_id long, user_id string, user_idx long, history array<string>, impressions array<struct<news_id: string, clicked: int>>"


@pytest.fixture(scope="module")
def log(spark):
    """Pages whose histories are the last ids of the pages before; unknown, null and repeated ids, and rows that repeat."""
    rows = []
    for user in range(3):
        for page in range(20):
            history = [f"N{(user * 5 + i) % 30}" for i in range(max(0, page - SIZE), page)] + ["gone", None][: page % 3]
            rows.append((user * 100 + page, f"U{user}", user, history or None, [(f"N{(user + page + i) % 33}", int(i % 3 == 0)) for i in range(5)] + [(None, 0)]))
    return spark.createDataFrame([*rows, rows[3], (900, None, None, None, []), (901, "U9", 77, ["N1", "N1"], None)], SCHEMA)


@pytest.fixture(scope="module")
def vectors(spark):
    """One id twice, one without a vector; stored as floats."""
    rows = [(f"N{i}", rng.normal(size=DIM).tolist()) for i in range(30)]
    return spark.createDataFrame([*rows, ("N7", [1.0, 2.0, 3.0, 4.0]), ("N31", None)], "news_id string, vec array<float>")


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([(i, rng.normal(size=DIM).tolist()) for i in range(3)], "user_idx long, vec array<double>")


def rounded(df):
    def one(x):
        return tuple(round(v, 9) for v in x) if isinstance(x, list) else round(x, 9) if isinstance(x, float) else x

    return sorted((tuple(one(x) for x in row) for row in df.collect()), key=str)


def same(build):
    want = rounded(build(True))
    assert want and rounded(build(False)) == want


@pytest.mark.parametrize("mask", [False, True])
def test_user_vectors(log, vectors, users, mask):
    known = vectors.where("vec is not null")
    same(lambda fits: att.user_vector_additive(log, known, ADDITIVE, SIZE, mask, fits=fits))
    same(lambda fits: att.user_vector_personalized(log, known, users, PERSONAL, SIZE, mask, fits=fits))
    same(lambda fits: att.user_vector_selfattn(log, known, SELF, ADDITIVE, SIZE, mask, fits=fits))
    if mask:
        return
    same(lambda fits: att.self_attention(log, vectors, SELF, SIZE, fits=fits).drop("slot"))
    same(lambda fits: att.user_vector_additive(log, vectors, ADDITIVE, SIZE, empty=[0.5] * DIM, fits=fits))


def test_scores_and_products(log, vectors, users):
    held = att.user_vector_additive(log, vectors, ADDITIVE, SIZE, fits=True).where(F.col("history_key") != att.history_key(F.array(F.lit("gone")), SIZE))
    known = held.where(F.substring("history_key", 1, 1) != "d")
    linear = LinearRanker(0.3, (1.0, -2.0, 0.5, 3.0))
    for given in (held, known, held.limit(0)):
        same(lambda fits: score_behaviors(log, vectors, given, SIZE, keep=("user_id",), fits=fits))
        same(lambda fits: score_behaviors_with_ranker(log, vectors, given, linear, SIZE, fits=fits))
        same(lambda fits: sampled_values(log, vectors, given, SIZE, 3, 42, 1, fits=fits))
        same(lambda fits: sampled_values(log, vectors, given, SIZE, 3, 42, 1, products=True, fits=fits))
    personal = att.user_vector_personalized(log, vectors, users, PERSONAL, SIZE, fits=True)
    same(lambda fits: score_behaviors(log, vectors, personal, SIZE, fits=fits))


def test_a_vector_comes_once_for_the_pages_of_a_user(spark, vectors, monkeypatch):
    pages = [(page, "U1", 1, [f"N{i}" for i in range(page, page + SIZE)], [(f"N{page}", 1)]) for page in range(24)]
    log = spark.createDataFrame(pages, SCHEMA).coalesce(1)
    met = []

    def recording(fact, *args, _plain=bundles.lookup, **kwargs):
        met.append(fact)
        return _plain(fact, *args, **kwargs)

    monkeypatch.setattr(bundles, "lookup", recording)
    assert att.user_vector_additive(log, vectors, ADDITIVE, SIZE, fits=False).count() == 24
    (pairs,) = met
    parts = pairs.select("_of").distinct().count()
    assert pairs.count() <= 29 + (parts - 1) * (SIZE - 1) < 24 * SIZE
