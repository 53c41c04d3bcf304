"""Queries that repeat titles move their digests, not the titles."""

import hashlib

import pytest
from pyspark.sql import functions as F

from checks import queries
from clickrank.operators import lookup, sampling

LONG = "word " * 4000


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    texts = [LONG, "plain\ttitle", None, " \n", "é short", "plain\ttitle"]
    spark.createDataFrame([(i, x, "en", "web") for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    events = [(i, 1 + i % 2, ["click", "view", "purchase"][i % 3]) for i in range(60)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").withColumn(
        "ts", F.timestamp_seconds(F.col("event_id") * 7000 + 1704067200)
    ).write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name", ["j1_candidate_titles", "j2_history_titles", "j5_candidate_texts", "j5_history_texts", "x5_training_examples", "x6_evaluation_examples"])
def test_titles_are_digested_before_they_are_joined(spark, folder, monkeypatch, name):
    joined = []

    def recording(rows, news_text, *args, _plain=lookup.with_text, **kwargs):
        joined.append(news_text)
        return _plain(rows, news_text, *args, **kwargs)

    monkeypatch.setattr(lookup, "with_text", recording)
    monkeypatch.setattr(sampling, "with_text", recording)
    found = queries.REGISTERED[name](spark, folder)
    rows = {(r["news_id"], r["title_md5"], r["title_length"]) for r in found.select("news_id", "title_md5", "title_length").collect()}
    titles = {"N0": LONG, "N1": "plain title", "N4": "é short", "N5": "plain title"}
    assert {n for n, _, _ in rows} >= {"N0", "N2", "N5"}
    for news_id, md5, length in rows:
        title = titles.get(news_id, "")
        assert (md5, length) == (hashlib.md5(title.encode()).hexdigest(), len(title)), news_id
    (texts,) = joined
    assert texts.agg(F.max(F.length("title"))).first()[0] < 50
