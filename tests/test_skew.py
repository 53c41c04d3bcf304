"""One user with a third of all events: their pages must be split over tasks and still give whole results."""

import shutil
from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from check import canonical
from checks import oracle, queries
from checks import tables as t
from clickrank.operators import scale


@pytest.fixture(scope="module")
def skewed_dir(tmp_path_factory, small):
    folder = tmp_path_factory.mktemp("skewed")
    for path in Path(small).glob("*.parquet"):
        shutil.copy(path, folder / path.name)
    start = datetime(2024, 1, 1)
    kinds = ("view", "click", "purchase", "signup", "error")
    events = []
    for i in range(2100):
        hot = i % 3 == 0
        ts = start + timedelta(days=3, seconds=i // 2) if hot else start + timedelta(hours=i % 160, seconds=i)
        events.append((i, ts, 5 if hot else i % 23, kinds[i * 7 % 5], float(i * 37 % 101), "{}"))
    frame = pd.DataFrame(events, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    (folder / "events.parquet").unlink()
    frame.to_parquet(folder / "events.parquet", coerce_timestamps="us")
    return str(folder)


@pytest.fixture
def low_limits(monkeypatch):
    """Groups above 100 rows count as hot."""
    monkeypatch.setattr(t, "HOT_ROWS", 100)
    monkeypatch.setattr(t, "BLOCK", 16)
    yield
    monkeypatch.undo()


def test_a_hot_user_has_many_pages(spark, skewed_dir, low_limits):
    shown = t.shown_news(spark, skewed_dir)
    sizes = {r[0]: r[1] for r in shown.groupBy("impression_id").count().collect()}
    assert sum(sizes.values()) == 2100 and max(sizes.values()) == t.PAGE
    assert len([k for k in sizes if k // t.USER_IDS == 5]) > 4 * t.BLOCK
    assert shown.select("impression_id", "pos").distinct().count() == 2100


@pytest.mark.parametrize(
    "name", ["p3_parse_history", "p6_explode_candidates", "p8_fit_history", "x3_shuffle_sample", "w7_auc", "w9_evaluate_run", "m9_listwise_loss"]
)
def test_queries_over_a_hot_user(spark, skewed_dir, low_limits, name):
    duck = duckdb.connect()
    for path in Path(skewed_dir).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got = canonical(queries.REGISTERED[name](spark, skewed_dir).toPandas())
    want = canonical(duck.sql(oracle.statements()[name]).df())
    assert got.equals(want)


def test_filters_and_columns_reach_the_scan(spark, small):
    def scan(df):
        text = df._jdf.queryExecution().executedPlan().toString()
        return next(line for line in text.splitlines() if "FileScan" in line)

    clicks = scan(t.event_log(spark, small).where("clicked = 1").select("news_id"))
    assert "DataFilters: [event_type" in clicks
    assert "props" not in clicks and "value" not in clicks
    assert "text" not in scan(t.news(spark, small).select("news_id", "category")).replace("text:", "")


def test_logs_are_packed_where_they_were_numbered(spark, small, executed_plan):
    plan = executed_plan(t.shown_news(spark, small).groupBy("impression_id", "user_id", "page").count())
    assert plan.count("Exchange") == 1


@pytest.mark.parametrize(
    "name",
    ["j1_candidate_titles", "x5_training_examples", "x6_evaluation_examples", "t5_encode_texts", "m3_personalized_attention_pool",
     "m5_user_vector_additive", "m7_user_vector_selfattn", "w8_evaluate"],
)
def test_queries_without_broadcasts_and_with_hot_keys(spark, small, monkeypatch, name):
    """What large tables do: no dimension is broadcast, and keys of more than 20 rows are salted."""
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(scale, "HOT_ROWS", 20)
    duck = duckdb.connect()
    for path in Path(small).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got = canonical(queries.REGISTERED[name](spark, small).toPandas())
    assert got.equals(canonical(duck.sql(oracle.statements()[name]).df()))


def test_salted_lookup_is_one_join(spark, executed_plan):
    fact = spark.createDataFrame([(1 if i % 2 else i, i) for i in range(100)] + [(None, 5)] * 30, "k long, v long")
    dim = spark.createDataFrame([(i, f"d{i}") for i in range(100)], "k long, d string")
    joined = scale.lookup(fact, dim, "k", fits=False, limit=20)
    assert executed_plan(joined.hint("merge")).count("SortMergeJoin") <= 1 and joined.columns == ["k", "v", "d"]
    want = sorted(((r.k, r.v, r.d) for r in fact.join(dim, "k", "left").collect()), key=str)
    assert sorted(((r.k, r.v, r.d) for r in joined.collect()), key=str) == want
