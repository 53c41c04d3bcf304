"""Histories pooled and lists scored in one pass: the same rows as with user vectors that are joined, and vectors met once."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_bundles import ADDITIVE, DIM, PERSONAL, SCHEMA, SELF, SIZE, log, rounded, users, vectors  # noqa: F401

from clickrank.operators import attention as att
from clickrank.operators import bundles
from clickrank.operators.pages import Additive, Personalized, SelfAttention, stored_pages
from clickrank.operators.ranker import LinearRanker
from clickrank.plans.evaluation import evaluate_additive, score_behaviors, score_behaviors_with_ranker
from clickrank.plans.training import sampled_values, train_ranker
from clickrank.schema import EMPTY_NEWS_ID
from clickrank.session import stage

LINEAR = LinearRanker(0.3, (1.0, -2.0, 0.5, 3.0))


def joined(rows, vectors, way):
    """User vectors as a table, by broadcasts."""
    return way.table(rows, vectors, True)


@pytest.mark.parametrize("mask", [False, True])
def test_one_pass(log, vectors, users, mask):  # noqa: F811
    twice = users.union(users.where("user_idx = 1"))
    known = vectors.where("vec is not null")
    for way in (Additive(ADDITIVE, SIZE, mask), Personalized(PERSONAL, twice, SIZE, mask)) + (() if mask else (SelfAttention(SELF, ADDITIVE, SIZE),)):
        scored = rounded(score_behaviors(log, known, joined(log, known, way), SIZE, keep=("user_id",), fits=True))
        assert len(scored) > 100
        assert rounded(score_behaviors(log, known, way, SIZE, keep=("user_id",), fits=False)) == scored


def test_stored(log, vectors, users):  # noqa: F811
    way, known = Personalized(PERSONAL, users, SIZE, True), vectors.where("vec is not null")
    table, pages = stage(joined(log, known, way)), stored_pages(log, known, way, keep=("user_id",), fits=False)
    want = rounded(score_behaviors_with_ranker(log, known, table, LINEAR, SIZE, fits=True))
    assert rounded(score_behaviors_with_ranker(pages, known, None, LINEAR, SIZE)) == want
    for products in (False, True):
        want = rounded(sampled_values(log, known, table, SIZE, 3, 42, 1, products, fits=True))
        assert rounded(sampled_values(log, known, way, SIZE, 3, 42, 1, products, fits=False)) == want
        assert rounded(sampled_values(pages, known, None, SIZE, 3, 42, 1, products)) == want


def test_vectors_of_the_empty_news_and_null_vectors(log, vectors):  # noqa: F811
    known = vectors.union(vectors.sparkSession.createDataFrame([(EMPTY_NEWS_ID, [0.5] * DIM)], vectors.schema))
    plain, way = log.where(~F.exists(F.coalesce("history", F.array()), lambda x: x.isNull())), Additive(ADDITIVE, SIZE)
    want = rounded(score_behaviors(plain, known, joined(plain, known, way), SIZE, fits=True))
    assert rounded(score_behaviors(plain, known, way, SIZE, fits=False)) == want
    assert rounded(score_behaviors(stored_pages(plain, known, way, fits=False), known, None, SIZE)) == want


def meetings(monkeypatch):
    met = []

    def recording(fact, dim, keys, *args, _plain=bundles.lookup, **kwargs):
        met.append(keys)
        return _plain(fact, dim, keys, *args, **kwargs)

    monkeypatch.setattr(bundles, "lookup", recording)
    monkeypatch.setattr("clickrank.plans.evaluation.fits_broadcast", lambda *_: False)
    monkeypatch.setattr("clickrank.plans.training.fits_broadcast", lambda *_: False)
    return met


def test_evaluation_meets_vectors_once(log, vectors, monkeypatch):  # noqa: F811
    want = evaluate_additive(log, vectors, ADDITIVE, SIZE).first()
    met = meetings(monkeypatch)
    found = evaluate_additive(log, vectors, ADDITIVE, SIZE).first()
    assert met == ["news_id"] and np.allclose([x or 0 for x in found], [x or 0 for x in want])


def test_training_and_its_evaluation_meet_vectors_once(log, vectors, monkeypatch):  # noqa: F811
    want = train_ranker(log, vectors, ADDITIVE, 3, SIZE, weight_decay=0.01)
    met = meetings(monkeypatch)
    pages = stored_pages(log, vectors, Additive(ADDITIVE, SIZE), fits=False)
    for rows in (log, pages):
        found = train_ranker(rows, vectors, ADDITIVE, 3, SIZE, weight_decay=0.01)
        assert np.allclose(found.coefficients, want.coefficients)
        assert score_behaviors_with_ranker(pages, vectors, None, found, SIZE).count() > 100
    assert met == ["news_id", "news_id"]


def test_empty_log(spark, vectors):  # noqa: F811
    none = spark.createDataFrame([], SCHEMA)
    way = Additive(ADDITIVE, SIZE)
    assert score_behaviors(none, vectors, way, SIZE, fits=False).count() == 0
    assert score_behaviors(stored_pages(none, vectors, way, fits=False), vectors, None, SIZE).count() == 0


def test_items_are_pooled_by_bundles(spark, vectors, users, monkeypatch):  # noqa: F811
    """M3: groups over several bundles and users, rows and users that repeat, unknown and null ids, users and keys (null keys only
    while no maximum is joined)."""
    rows = [(g if g % 7 else None, f"k{g % 2}", [0, 1, 2, 77, None][g % 5], f"N{(g * 3 + i) % 33}") for g in range(30) for i in range(6)]
    items = spark.createDataFrame([*rows, rows[4], (3, "k1", 1, None), (3, "k1", 2, "gone")], "g int, k string, user_idx long, news_id string")
    twice = users.union(users.where("user_idx = 1"))
    met = []

    def counted(pairs, *args, _plain=bundles.lookup, **kwargs):
        met.append(pairs.columns)
        return _plain(pairs, *args, **kwargs)

    for log_items, news in ((items, vectors), (items.where("g is not null"), vectors.withColumn("vec", F.transform("vec", lambda x: (x * 200).cast("float"))))):
        pooled = lambda fits: rounded(att.personalized_attention_pool(log_items, ["g", "k"], news, twice, PERSONAL, empty=[0.1] * DIM, fits=fits))  # noqa: B023, E731
        want = pooled(True)
        with monkeypatch.context() as patched:
            patched.setattr(bundles, "lookup", counted)
            patched.setattr(att, "ITEM_BITS", 3)
            assert pooled(False) == want
    assert sorted(met) == [["_of", "news_id"]] * 2 + [["_of", "user_idx"]] * 2
