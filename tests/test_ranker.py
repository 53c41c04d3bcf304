"""The ranker on all products: sums in a tree, Newton steps, a sample per epoch, stored weights and scores."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from clickrank.functions.dense import AdditiveWeights
from clickrank.operators import ranker
from clickrank.operators.attention import user_vector_additive
from clickrank.plans.evaluation import evaluate_ranker, score_behaviors_with_ranker
from clickrank.plans.training import sampled_candidates, train_ranker
from clickrank.schema import EMPTY_NEWS_ID

PRODUCTS = "product array<double>, clicked int"


def drawn(seed, n=400, dim=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    y = (rng.random(n) < 1 / (1 + np.exp(-(x @ np.arange(1, dim + 1) - 0.5)))).astype(int)
    return x, y


def products(spark, x, y, parts=5):
    return spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y)], PRODUCTS).repartition(parts)


def newton(x, y, w, decay=0.0):
    x = np.hstack([np.ones((len(x), 1)), x])
    p = 1 / (1 + np.exp(-x @ w))
    penalty = np.full(len(w), decay)
    penalty[0] = 0
    gram = x.T @ (x * (p * (1 - p))[:, None]) / len(x) + np.diag(penalty)
    return w - np.linalg.solve(gram, x.T @ (p - y) / len(x) + penalty * w)


@pytest.mark.parametrize("decay", [0.0, 0.1])
def test_steps_over_epochs_with_a_sample_each(spark, decay):
    samples = [drawn(seed) for seed in range(3)]
    fitted, seen = ranker.fit_epochs(lambda e: products(spark, *samples[e]), 3, epochs=3, weight_decay=decay)
    want = np.zeros(4)
    for x, y in samples:
        want = newton(x, y, want, decay)
    assert [fitted.intercept, *fitted.coefficients] == pytest.approx(want, rel=1e-9)
    assert [e.rows for e in seen] == [400] * 3
    assert seen[0].loss == pytest.approx(np.log(2)) and seen[1].loss < seen[0].loss


def test_converges_to_the_fit_of_the_library(spark):
    data = products(spark, *drawn(1))
    fitted, _ = ranker.fit_epochs(lambda e: data, 3, epochs=10, weight_decay=0.05)
    labelled = data.select(array_to_vector("product").alias("features"), F.col("clicked").cast("double").alias("label"))
    model = LogisticRegression(maxIter=200, regParam=0.05, tol=1e-12, standardization=False).fit(labelled)
    assert list(fitted.coefficients) == pytest.approx(list(model.coefficients), abs=1e-5)
    assert ranker.as_linear(model).intercept == pytest.approx(fitted.intercept, abs=1e-5)


def test_starts_from_given_weights(spark):
    x, y = drawn(2)
    start = ranker.LinearRanker(0.3, (0.1, 0.2, 0.3))
    moved, rows, _ = ranker.newton_step(products(spark, x, y), start)
    assert rows == 400
    assert [moved.intercept, *moved.coefficients] == pytest.approx(newton(x, y, np.array([0.3, 0.1, 0.2, 0.3])))


def test_defined_cases(spark):
    start = ranker.LinearRanker(1.0, (2.0, 3.0))
    none = spark.createDataFrame([], PRODUCTS)
    assert ranker.newton_step(none, start) == (start, 0, None)
    unknown = spark.createDataFrame([(None, 1), ([1.0, 1.0], None)], PRODUCTS)
    assert ranker.newton_step(unknown, start) == (start, 0, None)
    # The second number is always zero: nothing is known of its weight, which stays.
    flat = spark.createDataFrame([([1.0, 0.0], 1), ([-1.0, 0.0], 1), ([1.0, 0.0], 0), ([2.0, 0.0], 0)], PRODUCTS)
    moved, rows, _ = ranker.newton_step(flat, ranker.LinearRanker.zeros(2))
    assert rows == 4 and abs(moved.coefficients[1]) < 1e-12 and moved.coefficients[0] < 0
    with pytest.raises(Exception, match="for 3 weights"):
        ranker.newton_step(flat, ranker.LinearRanker.zeros(3))
    huge = spark.createDataFrame([([900.0], 1), ([-900.0], 0)], PRODUCTS)
    assert ranker.newton_step(huge, ranker.LinearRanker(0.0, (5.0,)))[2] == 0.0


def test_tree_of_sums(spark):
    parts = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(300)], "part int, sums array<double>").repartition(7)
    for levels, fan_in in ((1, 4), (2, 5), (3, 3)):
        assert ranker.tree_sums(parts, levels, fan_in).tolist() == [299 * 150, 300]


def test_weights_are_stored(spark, tmp_path):
    fitted = ranker.LinearRanker(0.25, tuple((np.arange(64) / 7).tolist()))
    for _ in range(2):
        ranker.save_weights(spark, fitted, str(tmp_path / "w"))
    assert ranker.load_weights(spark, str(tmp_path / "w")) == fitted
    ranker.weight_table(spark, fitted).where("place <> 1").write.parquet(str(tmp_path / "broken"))
    with pytest.raises(ValueError, match="no table of weights"):
        ranker.load_weights(spark, str(tmp_path / "broken"))


def test_scores_of_unknown_news_unknown_users_and_fillers(spark):
    news = spark.createDataFrame([("N1", [1.0, 2.0]), ("N2", [0.5, -1.0])], "news_id string, vec array<double>")
    shown = [(1, "N1", [1.0, 1.0]), (1, "N2", [1.0, 1.0]), (1, EMPTY_NEWS_ID, [1.0, 1.0]), (1, "gone", [1.0, 1.0]), (2, "N1", None), (2, "gone", None)]
    candidates = spark.createDataFrame(shown, "impression_id long, news_id string, user_vec array<double>")
    fitted = ranker.LinearRanker(10.0, (1.0, 0.5))
    scored = ranker.score_linear(candidates, news, fitted)
    assert scored.columns == ["impression_id", "news_id", "score"]
    got = {(r[0], r[1]): r["score"] for r in scored.collect()}
    assert got == {(1, "N1"): 12.0, (1, "N2"): 10.0, (1, EMPTY_NEWS_ID): 10.0, (1, "gone"): 10.0, (2, "N1"): None, (2, "gone"): None}
    given = {(r[0], r[1]): r["score"] for r in ranker.score_linear(candidates, news, fitted, empty=[4.0, 2.0]).collect()}
    assert given[1, "gone"] == given[1, EMPTY_NEWS_ID] == 15.0


def test_scoring_stays_in_the_jvm(spark, executed_plan):
    news = spark.createDataFrame([("N1", [1.0, 2.0])], "news_id string, vec array<double>")
    candidates = spark.createDataFrame([(1, "N1", [1.0, 1.0])], "impression_id long, news_id string, user_vec array<double>")
    plan = executed_plan(ranker.score_linear(candidates, news, ranker.LinearRanker(0.0, (1.0, 1.0))))
    assert "Python" not in plan and "Arrow" not in plan


BEHAVIORS = "impression_id long, user_id string, time string, history array<string>, impressions array<struct<news_id: string, clicked: int>>"


@pytest.fixture(scope="module")
def world(spark):
    """Users click what is like their history; one history is empty, one id is unknown."""
    rng = np.random.default_rng(7)
    news = {f"N{i}": rng.normal(size=4) for i in range(30)}
    rows = []
    for i in range(150):
        history = rng.choice(list(news), 4, replace=False).tolist()
        taste = sum(news[n] for n in history)
        ids = rng.choice(list(news), 6, replace=False).tolist()
        best = max(ids, key=lambda n: float(news[n] @ taste))
        rows.append((i, f"U{i % 9}", "t", history, [(n, int(n == best)) for n in ids]))
    rows += [(200, "U1", "t", None, [("N1", 1), ("N2", 0)]), (201, "U2", "t", ["gone"], [("gone", 1), ("N3", 0), ("N4", 0)])]
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in news.items()], "news_id string, vec array<double>")
    return spark.createDataFrame(rows, BEHAVIORS), vectors, AdditiveWeights(np.zeros((4, 2)), np.zeros(2), np.zeros(2))


def test_training_draws_anew_each_epoch(spark, world):
    behaviors, vectors, pooling = world
    ids = [
        {(r["impression_id"], r["slot"], r["news_id"]) for r in sampled_candidates(behaviors, 2, 42, epoch).collect()} for epoch in (0, 1)
    ]
    assert ids[0] != ids[1]
    one = train_ranker(behaviors, vectors, pooling, npratio=2, history_size=5, epochs=1, weight_decay=0.01)
    both = train_ranker(behaviors, vectors, pooling, npratio=2, history_size=5, epochs=2, weight_decay=0.01)
    users = user_vector_additive(behaviors, vectors, pooling, 5)
    from clickrank.operators.attention import attach_history_vector

    keyed = attach_history_vector(behaviors, users, 5)
    second = ranker.with_products(sampled_candidates(keyed, 2, 42, 1, keep=("user_vec",)), vectors)
    want = ranker.newton_step(second, one, 0.01)[0]
    assert [both.intercept, *both.coefficients] == pytest.approx([want.intercept, *want.coefficients], rel=1e-9)


def test_trained_ranker_is_evaluated_by_the_plan(spark, world):
    behaviors, vectors, pooling = world
    fitted = train_ranker(behaviors, vectors, pooling, npratio=4, history_size=5, epochs=4, weight_decay=0.01)
    users = user_vector_additive(behaviors, vectors, pooling, 5)
    means = evaluate_ranker(behaviors, vectors, users, fitted, history_size=5, include_empty=False).first()
    assert means["impressions"] == 152 and means["auc"] > 0.9
    scored = score_behaviors_with_ranker(behaviors, vectors, users, fitted, 5, include_empty=True)
    got = {(r["impression_id"], r["news_id"]): r["score"] for r in scored.where("impression_id >= 200").collect()}
    assert got[201, "gone"] == got[201, EMPTY_NEWS_ID] == pytest.approx(fitted.intercept, abs=1e-9)
    # A user without a vector: the impression has no score, so no metrics.
    unknown = users.where(F.lit(False))
    assert evaluate_ranker(behaviors, vectors, unknown, fitted, history_size=5).first()["with_auc"] == 0
