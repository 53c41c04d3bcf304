"""Hard negatives against brute force, and Strassen's product against the plain one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickrank.llm import hard_negatives as hn
from clickrank.llm.strassen import multiply

SCHEMA = "vec_id long, embedding array<double>, label int, rank string, _row string, _label string, score string"


def brute(rows, is_anchor, positives, negatives, scale, low=50, high=95):
    held = [
        (i, [int(np.floor(scale * c)) for c in x], y) for i, x, y in rows
        if None not in (i, x, y) and all(c is not None and np.isfinite(c) for c in x)
    ]
    score = lambda a, b: sum(p * q for p, q in zip(a, b))
    out = []
    for i, a, y in held:
        if is_anchor(i):
            same = sorted((-score(a, x), j) for j, x, z in held if j != i and z == y)[:positives]
            others = sorted((-score(a, x), j) for j, x, z in held if j != i and z != y)
            for s, j in same:
                inside = [(t, n) for t, n in others if low * -s <= 100 * -t <= high * -s][:negatives]
                out += [(i, j, place + 1, n, -s, -t) for place, (t, n) in enumerate(inside)]
    return sorted(out)


def mined(spark, rows, every=5, positives=3, negatives=2, scale=32, **sizes):
    df = spark.createDataFrame([(i, x, y, "clash", "clash", "clash", "clash") for i, x, y in rows], SCHEMA).repartition(3)
    found = hn.mine(df, F.col("vec_id") % every == 0, F.col("label"), positives, negatives, scale=scale, **sizes)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


def test_brute_force_over_shards_and_parts(spark):
    rng = np.random.default_rng(5)
    rows = [(i, np.abs(rng.normal(size=5)).round(2).tolist(), int(rng.integers(0, 3))) for i in range(200)]
    want = brute(rows, lambda i: i % 5 == 0, 3, 2, 32)
    assert len(want) > 100
    assert mined(spark, rows, shard_rows=30, part_rows=15) == want


def test_defined_cases(spark):
    rows = [
        (0, [1.0, 1.0], 0), (1, [1.0, 1.0], 0), (1, [1.0, 1.0], 0), (2, [1.0, 0.5], 0), (3, [0.9, 0.5], 1), (4, [0.9, 0.5], 1),
        (4, [0.9, 0.5], 1), (5, [0.6, 0.5], 1), (5, [0.6, 0.5], 1), (6, None, 1), (7, [None, 1.0], 1), (8, [float("nan"), 1.0], 1),
        (9, [float("inf"), 1.0], 1), (10, [0.7, 0.7], None), (None, [0.7, 0.7], 1), (15, [-1.0, -1.0], 2), (16, [1.0, 1.0], 2),
        (20, [0.0, 0.0], 3), (21, [0.0, 0.0], 3), (25, [0.5, 0.5], 4),
    ]
    got = mined(spark, rows, shard_rows=4)
    assert got == brute(rows, lambda i: i % 5 == 0, 3, 2, 32)
    assert {a for a, *_ in got} == {0, 5, 20}  # 15 has a positive below 0, 25 has none, 20 scores 0 with all
    assert len({(a, p) for a, p, *_ in got if a == 0}) == 2  # two positives of one id are listed each


def test_ties_copies_and_one_label_for_most_rows(spark):
    rows = [(i, [1.0, float(i % 2)], 0 if i % 4 else i % 3) for i in range(150)]
    assert mined(spark, rows, shard_rows=40) == brute(rows, lambda i: i % 5 == 0, 3, 2, 32)


def test_empty_tables_and_no_anchor(spark):
    assert mined(spark, [(1, [1.0], 0)]) == []
    assert mined(spark, [(0, None, 0)]) == []
    assert mined(spark, [(0, [1.0], 0)]) == []
    assert hn.mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 0, F.col("label")).count() == 0


def test_window_limits_are_exact():
    scores = np.array([0, 1, 2, 19, 20, 21, 99, 100, 101, 12345, 2**62])
    least, most = hn.Window100().limits(scores)
    for p, a, b in zip(scores.tolist(), least.tolist(), most.tolist()):
        assert 100 * a >= 50 * p > 100 * (a - 1)
        assert 100 * b <= 95 * p < 100 * (b + 1)


@pytest.mark.parametrize("shape", [(1, 1, 1), (7, 5, 3), (16, 16, 16), (17, 33, 18), (65, 64, 130), (100, 37, 101), (3, 0, 4), (0, 4, 4)])
@pytest.mark.parametrize("cutoff", [1, 4, 16])
def test_strassen(shape, cutoff):
    m, k, n = shape
    rng = np.random.default_rng(6)
    for size in (10, 1000, 1 << 28):
        a, b = rng.integers(-size, size, (m, k)), rng.integers(-size, size, (k, n))
        assert (multiply(a, b, cutoff) == a @ b).all()
