import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickrank.operators import scoring
from clickrank.operators.reports import METRICS, compare_runs


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([("N1", [1.0, 2.0]), ("N2", [0.5, -1.0])], "news_id string, vec array<double>")


def test_dot_products(spark, vectors):
    shown = spark.createDataFrame(
        [(1, "N1", [1.0, 1.0]), (1, "N2", [1.0, 1.0]), (1, "EMPTY_NEWS_ID", [1.0, 1.0]), (2, "N1", None)],
        "impression_id long, news_id string, user_vec array<double>",
    )
    got = {(r[0], r[1]): r["score"] for r in scoring.score_candidates(shown, vectors).collect()}
    assert got == {(1, "N1"): 3.0, (1, "N2"): -0.5, (1, "EMPTY_NEWS_ID"): 0.0, (2, "N1"): None}
    filled = scoring.score_candidates(shown, vectors, empty=[2.0, 5.0]).where("news_id = 'EMPTY_NEWS_ID'").first()
    assert filled["score"] == 7.0
    by_key = spark.createDataFrame([("h", [2.0, 0.0])], "history_key string, user_vec array<double>")
    keyed = spark.createDataFrame([(1, "N1", "h"), (2, "N1", "g")], "impression_id long, news_id string, history_key string")
    assert {r["impression_id"]: r["score"] for r in scoring.score_candidates(keyed, vectors, by_key).collect()} == {1: 2.0, 2: None}


def test_listwise_loss(spark):
    samples = {1: ([1.0, 2.0, 3.0], 0), 2: ([1000.0, -1000.0], 1), 3: ([0.0, 0.0], 0)}
    data = [(k, int(i == t), s) for k, (scores, t) in samples.items() for i, s in enumerate(scores)]
    df = spark.createDataFrame(data, "impression_id long, clicked int, score double")

    def loss(scores, target):
        top = max(scores)
        return math.log(sum(math.exp(s - top) for s in scores)) + top - scores[target]

    row = scoring.listwise_loss(df).first()
    assert row["samples"] == 3
    assert row["loss"] == pytest.approx(sum(loss(*s) for s in samples.values()) / 3)


def test_encoding_news(spark):
    texts = spark.createDataFrame([("N1", "aa b", "c"), ("N2", "b", "")], "news_id string, title string, category_description string")

    def lengths(batch):
        return np.stack([batch["title"].str.len(), batch["category_description"].str.len()], axis=1)

    assert {r[0]: r[1] for r in scoring.encode_news(texts, lengths).collect()} == {"N1": [4.0, 1.0], "N2": [1.0, 0.0]}
    default = {r[0]: r[1] for r in scoring.encode_news(texts, dim=32).collect()}
    assert all(len(v) == 32 for v in default.values())
    # "b" is in both texts, so only the words of one text weigh anything.
    assert sum(x > 0 for x in default["N1"]) == 2 and not any(default["N2"])


def test_ranker_learns_and_is_stored(spark, tmp_path):
    rng = np.random.default_rng(2)
    news = {f"N{i}": rng.normal(size=4) for i in range(40)}
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in news.items()], "news_id string, vec array<double>")
    shown = []
    for i in range(200):
        user = rng.normal(size=4)
        ids = list(rng.choice(list(news), 5, replace=False))
        best = max(ids, key=lambda n: float(news[n] @ user))
        shown += [(i, str(n), int(n == best), user.tolist()) for n in ids]
    candidates = spark.createDataFrame(shown, "impression_id long, news_id string, clicked int, user_vec array<double>")
    features = scoring.ranker_features(candidates, vectors)
    model = scoring.fit_ranker(features, epochs=20, weight_decay=0.001)
    assert min(model.coefficients) > 0
    scoring.save_ranker(model, str(tmp_path / "m"))
    scoring.save_ranker(model, str(tmp_path / "m"))
    loaded = scoring.load_ranker(str(tmp_path / "m"))
    scored = scoring.score_with_ranker(features, loaded)
    assert scored.columns == ["impression_id", "news_id", "clicked", "score"]
    mean = {r["clicked"]: r["s"] for r in scored.groupBy("clicked").agg(F.avg("score").alias("s")).collect()}
    assert mean[1] > mean[0]
    assert scored.count() == len(shown)


def test_ranker_trains_on_fillers_and_scores_unknown_candidates(spark):
    vectors = spark.createDataFrame([("N1", [1.0, 2.0]), ("N2", [3.0, 0.5])], "news_id string, vec array<double>")
    shown = [(1, "N1", 1, [1.0, 1.0]), (1, "EMPTY_NEWS_ID", 0, [1.0, 1.0]), (1, "gone", 0, [1.0, 1.0]), (2, "N2", 1, None), (3, "gone", 0, None)]
    candidates = spark.createDataFrame(shown, "impression_id long, news_id string, clicked int, user_vec array<double>")
    features = scoring.ranker_features(candidates, vectors)
    assert features.count() == 5 and features.where("known_user").count() == 3
    assert {tuple(r.features) for r in features.where("known_user").collect()} == {(1.0, 2.0), (0.0, 0.0)}
    model = scoring.fit_ranker(features, epochs=5, weight_decay=0.1)
    assert model.summary.predictions.count() == 3
    scores = {(r.impression_id, r.news_id): r.score for r in scoring.score_with_ranker(features, model).collect()}
    assert scores[2, "N2"] is None and scores[3, "gone"] is None
    assert scores[1, "gone"] == scores[1, "EMPTY_NEWS_ID"] < scores[1, "N1"]


# Published macro-averages: model, backbone, text method, AUC, MRR, nDCG@5, nDCG@10.
RUNS = [
    ("NAML", "DistilBERT", "title", 0.675, 0.292, 0.317, 0.384),
    ("NAML", "DistilBERT", "template", 0.690, 0.295, 0.327, 0.393),
    ("NAML", "DistilBERT", "generated", 0.713, 0.326, 0.363, 0.425),
    ("NAML", "BERT", "title", 0.700, 0.318, 0.350, 0.414),
    ("NAML", "BERT", "template", 0.696, 0.308, 0.340, 0.405),
    ("NAML", "BERT", "generated", 0.707, 0.322, 0.357, 0.420),
    ("NRMS", "DistilBERT", "title", 0.674, 0.297, 0.322, 0.387),
    ("NRMS", "DistilBERT", "template", 0.675, 0.311, 0.341, 0.400),
    ("NRMS", "DistilBERT", "generated", 0.707, 0.324, 0.359, 0.422),
    ("NRMS", "BERT", "title", 0.689, 0.306, 0.336, 0.400),
    ("NRMS", "BERT", "template", 0.667, 0.301, 0.329, 0.389),
    ("NRMS", "BERT", "generated", 0.706, 0.320, 0.355, 0.418),
    ("NPA", "DistilBERT", "title", 0.700, 0.311, 0.344, 0.408),
    ("NPA", "DistilBERT", "template", 0.698, 0.309, 0.342, 0.407),
    ("NPA", "DistilBERT", "generated", 0.707, 0.319, 0.354, 0.417),
    ("NPA", "BERT", "title", 0.689, 0.301, 0.332, 0.398),
    ("NPA", "BERT", "template", 0.694, 0.314, 0.345, 0.410),
    ("NPA", "BERT", "generated", 0.710, 0.324, 0.360, 0.422),
]


def test_comparison_of_published_runs(spark):
    metrics = spark.createDataFrame(RUNS, "model string, backbone string, method string, auc double, mrr double, ndcg_at_5 double, ndcg_at_10 double")
    report = compare_runs(metrics, ["title", "template", "generated"], "generated")
    assert report.columns == ["model", "backbone", "metric", "title", "template", "generated", "gain_over_title", "gain_over_template"]
    got = {(r["model"], r["backbone"], r["metric"]): r for r in report.collect()}
    assert len(got) == 6 * len(METRICS)
    best = got["NRMS", "BERT", "auc"]
    assert (best["title"], best["template"], best["generated"]) == (0.689, 0.667, 0.706)
    assert round(100 * best["gain_over_template"], 1) == 5.8
    assert all(r["gain_over_title"] > 0 and r["gain_over_template"] > 0 for r in got.values())


def test_comparison_averages_impressions(spark):
    data = [("m", "b", "x", 0.0, 1.0, 1.0, 1.0), ("m", "b", "x", 1.0, 1.0, 1.0, None), ("m", "b", "y", 1.0, 1.0, 1.0, 1.0)]
    metrics = spark.createDataFrame(data, "model string, backbone string, method string, auc double, mrr double, ndcg_at_5 double, ndcg_at_10 double")
    got = {r["metric"]: r for r in compare_runs(metrics, ["x", "y"], "y").collect()}
    assert got["auc"]["x"] == 0.5 and got["auc"]["gain_over_x"] == 1.0
    assert got["ndcg_at_10"]["x"] == 1.0
