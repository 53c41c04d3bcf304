"""Callers who know the size of a dimension build their plans without a job, and the rows are the same either way."""

import pytest
from pyspark.sql import functions as F

from clickrank.operators import lookup as look
from clickrank.operators import scale
from clickrank.operators.sampling import evaluation_examples, training_examples

BEHAVIORS = "impression_id long, user_id string, history array<string>, impressions array<struct<news_id: string, clicked: int>>"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Everything as files, so that building a plan over them needs no job of its own."""
    folder = str(tmp_path_factory.mktemp("lookups"))
    rows = [(i, f"U{i % 3}", [f"N{i % 4}", "gone"], [(f"N{i % 5}", 1), (f"N{i % 7}", 0), ("gone", 0)]) for i in range(20)]
    made = {
        "behaviors": spark.createDataFrame(rows, BEHAVIORS),
        "news": spark.createDataFrame(
            [(f"N{i}", f"s{i % 2}", f"title {i}", f"about {i}") for i in range(6)], "news_id string, subcategory string, title string, category_description string"
        ),
        "descriptions": spark.createDataFrame([("s0", "zero")], "category string, description string"),
        "users": spark.createDataFrame([("U0", 1), ("U1", 2)], "user_id string, user_idx long"),
        "vectors": spark.createDataFrame([(1, [1.0, 2.0])], "user_idx long, vec array<double>"),
    }
    for name, df in made.items():
        df.write.parquet(f"{folder}/{name}")
    return {name: spark.read.schema(df.schema).parquet(f"{folder}/{name}") for name, df in made.items()}


def built(t, **sizes):
    shown = t["behaviors"].select("impression_id", F.posexplode("impressions").alias("pos", "_i")).select("impression_id", "pos", "_i.*")
    texts = t["news"].select("news_id", "title", "category_description")
    indexed = t["behaviors"].select("impression_id", F.pmod("impression_id", F.lit(3)).alias("user_idx"))
    return {
        "j1": look.candidate_titles(shown, t["news"], **sizes),
        "j2": look.history_titles(t["behaviors"], t["news"], 4, **sizes),
        "j4": look.attach_description(t["news"].drop("category_description"), t["descriptions"], **sizes),
        "j5_candidates": look.candidate_texts(shown, texts, **sizes),
        "j5_history": look.history_texts(t["behaviors"], texts, 4, **sizes),
        "j9": look.attach_user_vector(indexed, t["vectors"], **sizes),
    }


def jobs_of(spark, build):
    context = spark.sparkContext
    context.setJobGroup("building", "plans only")
    try:
        before = len(context.statusTracker().getJobIdsForGroup("building"))
        found = build()
        return found, len(context.statusTracker().getJobIdsForGroup("building")) - before
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_a_stated_size_starts_no_job(spark, tables):
    found, jobs = jobs_of(spark, lambda: built(tables, fits=True))
    assert jobs == 0 and len(found) == 6
    # Measuring takes jobs, which is what the statement saves.
    assert jobs_of(spark, lambda: built(tables))[1] > 0


def test_rows_do_not_depend_on_the_statement(tables, as_rows):
    ways = [built(tables, fits=True), built(tables, fits=False), built(tables), built(tables, broadcast_bytes=0), built(tables, broadcast_bytes=1 << 30)]
    for name in ways[0]:
        first = as_rows(ways[0][name])
        assert first and all(as_rows(way[name]) == first for way in ways[1:]), name


@pytest.mark.parametrize("sizes", [{"fits": True}, {"fits": False}, {"broadcast_bytes": 0}])
def test_examples_with_a_stated_size(tables, as_rows, sizes):
    t, texts = tables, tables["news"].select("news_id", "title")
    for build in (
        lambda **s: training_examples(t["behaviors"], texts, t["users"], 2, 3, 42, **s),
        lambda **s: evaluation_examples(t["behaviors"], texts, t["users"], 3, **s),
    ):
        assert as_rows(build(**sizes)) == as_rows(build())


def test_broadcast_bytes_is_the_limit(spark, tables, executed_plan):
    assert "BroadcastHashJoin" in executed_plan(built(tables, broadcast_bytes=1 << 30)["j4"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "BroadcastHashJoin" not in executed_plan(built(tables, broadcast_bytes=0)["j4"])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_large_files_are_not_measured(spark, tables, monkeypatch):
    news = tables["news"].select("news_id", "title")
    size = scale.scanned_bytes(news)
    assert size and scale.scanned_bytes(look.with_empty_news(news)) == size
    assert scale.scanned_bytes(news.where("title = 'x'")) is None
    assert scale.scanned_bytes(news.join(tables["users"], news["title"] == tables["users"]["user_id"])) is None
    assert scale.scanned_bytes(news.distinct()) is None
    assert scale.scanned_bytes(spark.createDataFrame([(1,)], "x int")) is None
    monkeypatch.setattr(scale, "BROADCAST_BYTES", size // scale.FAR_LARGER - 1)
    fits, jobs = jobs_of(spark, lambda: scale.fits_broadcast(news))
    assert not fits and jobs == 0
    monkeypatch.setattr(scale, "BROADCAST_BYTES", size)
    fits, jobs = jobs_of(spark, lambda: scale.fits_broadcast(news))
    assert fits and jobs > 0
