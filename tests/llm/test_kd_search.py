"""The k best rows by inner product against brute force, in one tree and over shards."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickrank.llm import kd_search, vectors

SCHEMA = "vec_id long, embedding array<double>, label int, score string, rank string, _row string, _id string"


def whole(vec, scale, dim):
    return [int(np.floor(scale * x)) for x in vec] + [0] * (dim - len(vec))


def brute(rows, is_query, k, scale):
    rows = [(i, x) for i, x in rows if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    dim = max((len(x) for _, x in rows), default=0)
    exact = [(i, whole(x, scale, dim)) for i, x in rows]
    out = []
    for i, q in exact:
        if is_query(i):
            scored = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in exact if j != i)
            out += [(i, place + 1, j, -s) for place, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, x, 0, "clash", "clash", "clash", "clash") for i, x in rows], SCHEMA).repartition(3)


def answers(spark, rows, every=5, k=4, scale=16, **sizes):
    found = kd_search.top_k(table(spark, rows), F.col("vec_id") % every == 0, k, scale=scale, **sizes)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in found.collect())


def test_brute_force_over_shards_and_parts(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(300)]
    got = answers(spark, rows, shard_rows=25, leaf_rows=4, part_rows=20)
    assert got == brute(rows, lambda i: i % 5 == 0, 4, 16)


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (5, [1.0, 0.0]), (5, [1.0, 0.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, []), (9, [2.0]),
        (10, None), (11, [None, 1.0]), (12, [nan, 1.0]), (13, [inf, 1.0]), (None, [9.0, 9.0]), (15, [-1.0, -3.0]),
        (20, []), (21, [0.03, -0.03]), (-5, [0.5, 0.5]),
    ]
    got = answers(spark, rows, k=6, shard_rows=3, leaf_rows=1)
    assert got == brute(rows, lambda i: i % 5 == 0, 6, 16)
    assert {q for q, *_ in got} == {0, 5, 15, 20, -5}
    assert sum(q == 5 for q, *_ in got) == 12  # the row that repeats is answered twice


def test_fewer_than_k_and_empty_tables(spark):
    assert answers(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 16 * 32)]
    assert answers(spark, [(0, [1.0])]) == []
    assert answers(spark, [(0, None)]) == []
    empty = spark.createDataFrame([], SCHEMA)
    assert kd_search.top_k(empty, F.col("vec_id") % 5 == 0).count() == 0


def test_copies_of_one_vector_and_ties(spark):
    rows = [(i, [1.0, 1.0]) for i in range(120)] + [(200 + i, [float(i % 3), 1.0]) for i in range(60)]
    assert answers(spark, rows, every=10, shard_rows=40, leaf_rows=8) == brute(rows, lambda i: i % 10 == 0, 4, 16)


def test_scores_beyond_double_precision(spark):
    rows = [(0, [2.0**26 + 1, 1.0]), (1, [2.0**26 + 1, 3.0]), (2, [2.0**26 + 1, 2.0]), (3, [2.0**26, 0.0])]
    assert answers(spark, rows, scale=1) == brute(rows, lambda i: i % 5 == 0, 4, 1)
    assert answers(spark, rows, scale=1)[0][2:] == (1, (2**26 + 1) ** 2 + 3)
    with pytest.raises(Exception, match="64 bits"):
        answers(spark, [(0, [2.0**40]), (1, [2.0**40])], scale=1)


def tree_of(x, leaf_rows):
    order, low, high = kd_search.build_tree(x, leaf_rows)
    return x[order], order.astype(np.int64), low, high


def test_boxes_are_tight_and_halves_equal():
    x = np.random.default_rng(2).integers(-50, 50, (100, 3))
    placed, order, low, high = tree_of(x, 8)
    assert sorted(order) == list(range(100))
    for at, lo, hi in zip(kd_search.halves(100, len(low) - 1), low, high):
        assert np.diff(at).max() - np.diff(at).min() <= 1
        for a, b, least, most in zip(at[:-1], at[1:], lo, hi):
            assert (placed[a:b].min(axis=0) == least).all() and (placed[a:b].max(axis=0) == most).all()


def test_a_bar_handed_in_saves_leaves_and_loses_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.integers(-400, 400, (16, 4))
    x = (centres[:, None, :] + rng.integers(-5, 5, (16, 32, 4))).reshape(-1, 4)
    placed, ids, low, high = tree_of(x, 32)
    queries = x[::40]
    scores = queries @ placed.T
    kth = np.sort(scores, axis=1)[:, -5]
    own = np.full(len(queries), -1)
    read = []
    product = vectors.product
    monkeypatch.setattr(vectors, "product", lambda a, b: read.append(a.shape[0] * b.shape[1]) or product(a, b))
    cold = kd_search.search_tree(queries, own, np.full(len(queries), kd_search._LEAST), 5, placed, ids, low, high)
    n_cold = sum(read)
    warm = kd_search.search_tree(queries, own, kth, 5, placed, ids, low, high)
    assert sum(read) - n_cold <= n_cold < len(queries) * len(placed) / 2
    for heaps in (cold, warm):
        assert (heaps.scores == -np.sort(-scores, axis=1)[:, :5]).all()


def test_heaps_merge():
    rng = np.random.default_rng(4)
    rows, scores, ids = rng.integers(0, 7, 400), rng.integers(0, 9, 400), rng.permutation(400)
    at_once, merged = vectors.Heaps(8, 3), vectors.Heaps(8, 3)
    at_once.offer(rows, scores, ids)
    for part in np.array_split(np.arange(400), 5):
        other = vectors.Heaps(8, 3)
        other.offer(rows[part], scores[part], ids[part])
        merged.merge(other)
    want = [
        (r, s, i) for r in range(8) for s, i in sorted(((s, i) for a, s, i in zip(rows, scores, ids) if a == r), key=lambda x: (-x[0], x[1]))[:3]
    ]
    for heaps in (at_once, merged):
        assert list(zip(*heaps.entries())) == want
