import math
import random

import pytest
from pyspark.sql import functions as F

from clickrank.operators import ranking as rank

SCHEMA = "impression_id long, pos int, clicked int, score double"


def frame(spark, impressions):
    data = [
        (key, pos, clicked, score)
        for key, items in impressions.items()
        for pos, (clicked, score) in enumerate(items)
    ]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def brute_force(items):
    """The four metrics of one impression, by their definitions."""
    order = sorted(range(len(items)), key=lambda i: (items[i][1], i), reverse=True)
    labels = [items[i][0] for i in order]
    p, n = sum(labels), len(labels) - sum(labels)

    def dcg(ys, k):
        return sum((2**y - 1) / math.log2(r + 1) for r, y in enumerate(ys[:k], 1))

    if p == 0:
        return None, None, None, None
    best = sorted(labels, reverse=True)
    pairs = [
        1.0 if a[1] > b[1] else 0.5 if a[1] == b[1] else 0.0
        for a in items if a[0] == 1 for b in items if b[0] == 0
    ]
    auc = sum(pairs) / len(pairs) if n else None
    mrr = sum(y / r for r, y in enumerate(labels, 1)) / p
    return dcg(labels, 5) / dcg(best, 5), dcg(labels, 10) / dcg(best, 10), auc, mrr


@pytest.fixture(scope="module")
def random_impressions():
    rng = random.Random(11)
    sizes = [1, 2, 3, 5, 8, 13, 30] * 4 + [400]
    return {i: [(int(rng.random() < 0.3), float(rng.randrange(7))) for _ in range(n)] for i, n in enumerate(sizes)}


def close(got, want):
    return all((a is None and b is None) or (a is not None and b is not None and abs(a - b) < 1e-9) for a, b in zip(got, want))


def test_published_vectors(spark):
    scored = frame(spark, {1: [(0, 0.3), (1, 0.5), (0, 0.0), (0, 0.0), (1, 0.2)]})
    assert rank.dcg_at_k(scored, 5).first()["dcg"] == 1.5
    assert rank.dcg_at_k(scored, 10).first()["dcg"] == 1.5
    assert rank.ndcg_at_k(scored, 5).first()["ndcg"] == pytest.approx(0.9197207, abs=1e-7)
    assert rank.ndcg_at_k(scored, 10).first()["ndcg"] == pytest.approx(0.9197207, abs=1e-7)
    assert rank.mrr(scored).first()["mrr"] == pytest.approx(2 / 3)
    assert rank.auc(scored).first()["auc"] == pytest.approx(5 / 6)
    row = rank.evaluate(scored).first()
    assert row["ndcg_at_5"] == pytest.approx(0.9197207, abs=1e-7) and row["auc"] == pytest.approx(5 / 6)


@pytest.mark.parametrize("limit", [1, 6, 100, 1_000_000])
def test_evaluate_agrees_with_definitions_for_any_group_limit(spark, random_impressions, limit):
    got = {r[0]: tuple(r[1:]) for r in rank.evaluate(frame(spark, random_impressions), limit=limit).collect()}
    assert set(got) == set(random_impressions)
    for key, items in random_impressions.items():
        assert close(got[key], brute_force(items)), key


def test_single_metrics_agree_with_evaluate(spark, random_impressions):
    scored = frame(spark, random_impressions)
    whole = {r[0]: r for r in rank.evaluate(scored).collect()}
    for limit in (6, 1_000_000):
        for fn, name in ((rank.mrr, "mrr"), (rank.auc, "auc")):
            for r in fn(scored, limit=limit).collect():
                assert close((r[name],), (whole[r[0]][name],))
    for r in rank.ndcg_at_k(scored, 5).collect():
        assert close((r["ndcg"],), (whole[r[0]]["ndcg_at_5"],))


def test_ties_go_to_the_later_position(spark):
    ranked = rank.rank_candidates(frame(spark, {1: [(0, 1.0), (1, 1.0), (0, 2.0)]})).collect()
    assert {r["pos"]: r["rank"] for r in ranked} == {2: 1, 1: 2, 0: 3}


def test_ideal_rank_puts_clicks_first(spark):
    ranked = rank.ideal_rank(frame(spark, {1: [(0, 9.0), (1, 1.0), (0, 2.0), (1, 0.0)]})).collect()
    assert {r["pos"]: r["ideal_rank"] for r in ranked} == {3: 1, 1: 2, 2: 3, 0: 4}


def test_impressions_without_clicks_or_without_others(spark):
    metrics = rank.evaluate(frame(spark, {1: [(0, 1.0), (0, 2.0)], 2: [(1, 1.0)], 3: [(1, 2.0), (0, 1.0)]}))
    by_key = {r[0]: tuple(r[1:]) for r in metrics.collect()}
    assert by_key[1] == (None, None, None, None)
    assert by_key[2] == (1.0, 1.0, None, 1.0)
    assert by_key[3] == (1.0, 1.0, 1.0, 1.0)
    mean = rank.macro_average(metrics).first()
    assert (mean["impressions"], mean["with_positive"], mean["with_auc"]) == (3, 2, 1)
    assert mean["mrr"] == 1.0


@pytest.mark.parametrize("limit", [1, 1000])
def test_a_missing_score_leaves_no_metric(spark, limit):
    scored = frame(spark, {1: [(1, None), (0, 1.0)], 2: [(1, 1.0), (0, 0.0)]})
    by_key = {r[0]: tuple(r[1:]) for r in rank.evaluate(scored, limit=limit).collect()}
    assert by_key == {1: (None,) * 4, 2: (1.0,) * 4}


def test_top_k_cuts_groups_before_the_shuffle(spark, random_impressions, executed_plan):
    top = rank.top_k(frame(spark, random_impressions), 3)
    assert executed_plan(top).count("WindowGroupLimit") == 2
    assert max(r["count"] for r in top.groupBy("impression_id").count().collect()) == 3


def test_evaluation_needs_one_exchange_and_one_sort(spark, small, executed_plan):
    scored = spark.read.parquet(f"{small}/events.parquet").select(
        F.col("user_id").alias("impression_id"), F.col("event_id").cast("int").alias("pos"),
        F.lit(1).alias("clicked"), F.col("value").alias("score"),
    )
    plan = executed_plan(rank.evaluate(scored, bounded=True))
    assert plan.count("Exchange") == 1
    assert plan.count("Sort [") == 1


def test_keys_may_name_runs(spark):
    scored = frame(spark, {1: [(1, 2.0), (0, 1.0)]})
    runs = scored.withColumn("run", F.lit("a")).unionByName(scored.withColumns({"run": F.lit("b"), "score": -F.col("score")}))
    metrics = rank.evaluate(runs, keys=("run", "impression_id"))
    assert {r["run"]: r["auc"] for r in metrics.collect()} == {"a": 1.0, "b": 0.0}
    assert {r["run"]: r["auc"] for r in rank.macro_average(metrics, "run").collect()} == {"a": 1.0, "b": 0.0}


def test_missing_scores_and_labels_make_every_metric_null(spark):
    rows = [(1, 0, 1, None), (1, 1, 0, 0.5), (2, 0, 1, 0.9), (2, 1, None, 0.5), (2, 2, 0, 0.1), (3, 0, 1, 0.9), (3, 1, 0, 0.1)]
    scored = spark.createDataFrame(rows, "impression_id long, pos int, clicked int, score double")
    for limit in (1, 100):
        for metric in (
            rank.dcg_at_k(scored, 5, limit=limit), rank.ndcg_at_k(scored, 5, limit=limit), rank.mrr(scored, limit=limit),
            rank.auc(scored, limit=limit),
        ):
            found = {r[0]: r[1] for r in metric.collect()}
            assert found[1] is None and found[2] is None and found[3] == 1.0
        whole = {r.impression_id: r for r in rank.evaluate(scored, limit=limit).collect()}
        assert set(whole[1][1:]) == set(whole[2][1:]) == {None} and set(whole[3][1:]) == {1.0}
