"""Hashed TF-IDF against a count by hand."""

import hashlib
import math
from collections import Counter

import pytest

from clickrank.operators import hashing

TEXTS = {"N1": ("a b a", "c"), "N2": ("b", None), "N3": ("", "  \t\n"), "N4": (None, "a d\te\nf a a"), "N5": ("é é", "b")}


def place(token, dim):
    return int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim


def by_hand(dim):
    counts = {k: Counter(place(t, dim) for x in texts if x for t in x.split()) for k, texts in TEXTS.items()}
    df = Counter(b for c in counts.values() for b in c)
    return {k: {b: n * math.log((len(TEXTS) + 1) / (df[b] + 1)) for b, n in c.items()} for k, c in counts.items()}


@pytest.fixture(scope="module")
def news(spark):
    return spark.createDataFrame([(k, *v) for k, v in TEXTS.items()], "news_id string, title string, abstract string").repartition(3)


@pytest.mark.parametrize("dim", [1, 3, 64, 1 << 20])
def test_sparse_vectors(spark, news, dim):
    found = hashing.hashed_tfidf(news, dim).collect()
    assert len(found) == len(TEXTS)
    for r in found:
        assert r["buckets"] == sorted(r["buckets"]) and len(r["weights"]) == len(r["buckets"])
        assert dict(zip(r["buckets"], r["weights"])) == pytest.approx(by_hand(dim)[r["news_id"]])


def test_dense_vectors(spark, news):
    want = by_hand(16)
    for r in hashing.dense(hashing.hashed_tfidf(news, 16), 16).collect():
        assert r["vec"] == pytest.approx([want[r["news_id"]].get(i, 0.0) for i in range(16)])


def test_defined_cases(spark, news):
    assert hashing.hashed_tfidf(news.limit(0), 8).count() == 0
    for dim in (0, (1 << 20) + 1):
        with pytest.raises(ValueError, match="dim is"):
            hashing.hashed_tfidf(news, dim)
