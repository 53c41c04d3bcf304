import pytest
from pyspark.sql import functions as F

from clickrank.operators import sampling
from clickrank.operators.lookup import history_titles

SCHEMA = "impression_id long, user_id string, history array<string>, impressions array<struct<news_id:string,clicked:int>>"


def make(spark, n=60):
    data = []
    for i in range(n):
        items = [(f"N{i}_{j}", int(j % 4 == i % 4)) for j in range(i % 11 + 1)]
        data.append((i, f"U{i % 7}", None if i % 5 == 0 else [f"H{j}" for j in range(i % 9)], items))
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def behaviors(spark):
    return make(spark).repartition(5).cache()


@pytest.fixture(scope="module")
def index(spark):
    return spark.createDataFrame([(f"U{i}", i) for i in range(5)], "user_id string, user_idx long")


def drawn(df, **kw):
    return {r["impression_id"]: r for r in sampling.draw_sample(df, 4, **{"seed": 1, **kw}).collect()}


def test_every_sample_has_one_click_and_npratio_others(behaviors):
    shown = {r["impression_id"]: r["impressions"] for r in behaviors.collect()}
    samples = drawn(behaviors)
    assert set(samples) == {k for k, items in shown.items() if any(x["clicked"] for x in items)}
    for key, row in samples.items():
        sample = row["sample"]
        assert len(sample) == 5 and sum(x["clicked"] for x in sample) == 1
        assert sample[row["target"]]["clicked"] == 1
        real = [x for x in sample if x["pos"] >= 0]
        assert len({x["pos"] for x in real}) == len(real)
        assert all(shown[key][x["pos"]]["news_id"] == x["news_id"] for x in real)
        negatives = sum(1 for x in shown[key] if not x["clicked"])
        assert len(real) == 1 + min(4, negatives)
        assert all(x["news_id"] == "EMPTY_NEWS_ID" and x["clicked"] == 0 for x in sample if x["pos"] < 0)


def test_samples_depend_on_seed_and_epoch_only(behaviors):
    first = drawn(behaviors)
    assert drawn(behaviors.repartition(2)) == first
    assert drawn(behaviors, epoch=1) != first
    assert drawn(behaviors, seed=2) != first


def test_draws_are_spread_over_the_candidates(spark):
    one = [(i, "U", None, [("a", 0), ("b", 0), ("c", 1), ("d", 1)]) for i in range(2000)]
    df = spark.createDataFrame(one, SCHEMA)
    picked = sampling.draw_sample(df, 1, 5).select(F.inline("sample")).groupBy("news_id").count().collect()
    assert all(880 < r["count"] < 1120 for r in picked) and len(picked) == 4
    slots = sampling.draw_sample(df, 1, 5).groupBy("target").count().collect()
    assert all(880 < r["count"] < 1120 for r in slots)


def test_drawing_moves_no_rows(spark, executed_plan):
    assert "Exchange" not in executed_plan(sampling.draw_sample(make(spark), 4, 1))


def test_training_rows(spark, behaviors, index):
    news = spark.createDataFrame(
        [(f"N{i}_{j}", f"title {i} {j}") for i in range(60) for j in range(12)] + [(f"H{j}", f"read {j}") for j in range(9)],
        "news_id string, title string",
    )
    ids = {r["impression_id"]: r for r in sampling.training_examples(behaviors, None, index, 4, 3, 1).collect()}
    texts = {r["impression_id"]: r for r in sampling.training_examples(behaviors, news, index, 4, 3, 1, strict=True).collect()}
    assert set(ids) == set(texts) == set(drawn(behaviors))
    for key, row in texts.items():
        assert [x["news_id"] for x in row["candidates"]] == [x["news_id"] for x in ids[key]["candidates"]]
        assert [x["news_id"] for x in row["history"]] == ids[key]["history"] and len(row["history"]) == 3
        assert row["candidates"][row["target"]]["clicked"] == 1
        for item in row["candidates"]:
            assert item["title"] == ("" if item["news_id"] == "EMPTY_NEWS_ID" else "title " + item["news_id"][1:].replace("_", " "))
        assert row["user_idx"] == (key % 7 if key % 7 < 5 else 0)
    with pytest.raises(KeyError):
        sampling.training_examples(behaviors, news.where("news_id like 'N%'"), index, 4, 3, 1, strict=True)


@pytest.mark.parametrize("include_empty", [True, False])
def test_evaluation_rows(behaviors, index, include_empty):
    shown = {r["impression_id"]: r["impressions"] for r in behaviors.collect()}
    got = {r["impression_id"]: r for r in sampling.evaluation_examples(behaviors, None, index, 3, include_empty).collect()}
    for key, row in got.items():
        assert row["labels"] == [x["clicked"] for x in shown[key]] + [0] * include_empty
        assert len(row["candidates"]) == len(shown[key]) + include_empty
    assert set(got) == set(shown)


def test_batches_are_full_and_shuffled(spark):
    examples = spark.range(1000).select(F.col("id").alias("impression_id"))
    got = sampling.assign_batches(examples, 64, 9).collect()
    places = sorted((r["batch"], r["place"]) for r in got)
    assert places == [(i // 64, i % 64) for i in range(1000)]
    order = [r["impression_id"] for r in sorted(got, key=lambda r: (r["batch"], r["place"]))]
    assert order != sorted(order) and sorted(order) == list(range(1000))
    other = sampling.assign_batches(examples.repartition(3), 64, 9).collect()
    assert {r["impression_id"]: r["batch"] for r in other} == {r["impression_id"]: r["batch"] for r in got}


def test_texts_are_not_shuffled_when_news_are_broadcast(spark, behaviors, index, executed_plan):
    news = spark.createDataFrame([("N1_1", "a")], "news_id string, title string")
    plan = executed_plan(sampling.training_examples(make(spark), news, index, 4, 3, 1))
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.index("ObjectHashAggregate") < plan.index("Exchange hashpartitioning")
    exchange = next(line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
    assert "hashpartitioning(impression_id" in exchange


def test_equal_ids_in_two_splits_stay_apart(spark, index):
    """The table of both splits is used as it is, with the split as part of the key."""
    one = make(spark).withColumn("split", F.lit("train"))
    both = one.unionByName(make(spark).withColumn("split", F.lit("val")))
    news = spark.createDataFrame([("N1_1", "a")], "news_id string, title string")
    keys = ("split", "impression_id")
    for rows in (
        sampling.training_examples(both, news, index, 4, 3, 1, keys=keys),
        sampling.evaluation_examples(both, news, index, 3, keys=keys),
        history_titles(both, news, 3, keys=keys),
    ):
        counts = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}
        assert counts["train"] == counts["val"] == rows.select(*keys).distinct().count() / 2
    slots = history_titles(both, news, 3, keys=keys).select(F.size("history").alias("n")).distinct().collect()
    assert [r.n for r in slots] == [3]
