import pytest
from pyspark.sql import functions as F

from clickrank.functions.arrays import all_elements, fit_history, target_index, uniq_elements
from clickrank.operators import behaviors as beh
from clickrank.operators import lookup, users

LINES = "impression_id long, user_id string, time string, history_str string, impressions_str string"


@pytest.fixture(scope="module")
def lines(spark):
    data = [
        (1, "U1", "t", "N1 N2", "N3-0 N4-1"),
        (2, "U2", "t", None, "N5-1 N6-0 N7-0"),
        (3, "U3", "t", "", "N3-0 N4-0"),
        (4, "U1", "t", "N1", "N3-1"),
    ]
    return spark.createDataFrame(data, LINES)


@pytest.fixture(scope="module")
def parsed(lines):
    return beh.parse_behaviors(lines)


def test_parsing(parsed):
    assert parsed.columns == ["impression_id", "user_id", "time", "history", "impressions"]
    got = {r["impression_id"]: r for r in parsed.collect()}
    assert got[1]["history"] == ["N1", "N2"] and got[2]["history"] is None and got[3]["history"] is None
    assert [tuple(x) for x in got[1]["impressions"]] == [("N3", 0), ("N4", 1)]


def test_unlabelled_items(spark):
    lines = spark.createDataFrame([(1, "U1", "t", "N1", "N3 N4")], LINES)
    assert [x["clicked"] for x in beh.parse_behaviors(lines).first()["impressions"]] == [None, None]
    with pytest.raises(Exception, match="unlabelled"):
        beh.parse_behaviors(lines, strict=True).collect()


def test_positions_and_stats(parsed):
    got = {r["impression_id"]: (r["clicked_idxes"], r["non_clicked_idxes"]) for r in beh.click_positions(parsed).collect()}
    assert got == {1: ([1], [0]), 2: ([0], [1, 2]), 3: ([], [0, 1]), 4: ([0], [])}
    stats = {r[0]: tuple(r[1:]) for r in beh.click_stats(parsed, 2).collect()}
    assert stats == {1: (1, 1, 0, 1), 2: (1, 2, 0, 0), 3: (0, 2, 1, 0), 4: (1, 0, 0, 1)}


def test_explode_with_the_empty_candidate(parsed, as_rows):
    got = as_rows(beh.explode_candidates(parsed.where("impression_id = 1"), include_empty=True))
    assert got == [(1, 0, "N3", 0), (1, 1, "N4", 1), (1, 2, "EMPTY_NEWS_ID", 0)]


def test_history_is_cut_and_padded(parsed):
    fitted = parsed.select("impression_id", fit_history(F.col("history"), 1).alias("one"), fit_history(F.col("history"), 3).alias("three"))
    got = {r[0]: (r[1], r[2]) for r in fitted.collect()}
    e = "EMPTY_NEWS_ID"
    assert got[1] == (["N1"], ["N1", "N2", e]) and got[2] == ([e], [e, e, e])


def test_array_forms(spark):
    row = spark.range(1).select(
        target_index(F.array(F.lit(0), F.lit(1), F.lit(1))).alias("target"),
        all_elements(F.array(F.lit(1), F.lit(2)), lambda x: x > 0).alias("positive"),
        F.size(uniq_elements(F.array(F.lit(1), F.lit(1)))).alias("distinct"),
    ).first()
    assert tuple(row) == (1, True, 1)


def test_all_match(spark):
    df = spark.range(5)
    assert beh.all_match(df, F.col("id") < 5).first()[0] is True
    assert beh.all_match(df, F.col("id") < 4).first()[0] is False
    assert beh.all_match(df.limit(0), F.col("id") < 0).first()[0] is True


def test_user_index(spark, as_rows):
    train = spark.createDataFrame([("c",), ("a",), ("b",), ("a",)], "user_id string")
    val = spark.createDataFrame([("b",), ("z",), ("z",), ("y",)], "user_id string")
    index = users.build_user_index(train, val)
    assert as_rows(index) == [("a", 1), ("b", 2), ("c", 3), ("y", 0), ("z", 0)]
    assert index.count() == users.user_set_union(train, val).count()
    assert as_rows(users.validation_only_users(train, val)) == [("y",), ("z",)]
    assert tuple(users.user_count(index, only_train=True).first()) == (3, 4)
    assert tuple(users.user_count(index, only_train=False).first()) == (5, 6)
    seen = spark.createDataFrame([(1, "a"), (2, "y"), (3, "unheard of")], "impression_id long, user_id string")
    attached = users.attach_user_idx(seen, index)
    assert {r["impression_id"]: r["user_idx"] for r in attached.collect()} == {1: 1, 2: 0, 3: 0}


def test_titles_and_missing_news(spark, parsed, as_rows):
    news = spark.createDataFrame([("N3", "three"), ("N4", None)], "news_id string, title string")
    shown = beh.explode_candidates(parsed.where("impression_id in (1, 2)"), include_empty=True)
    titled = {(r["impression_id"], r["news_id"]): r["title"] for r in lookup.candidate_titles(shown, news).collect()}
    assert titled[1, "N3"] == "three" and titled[1, "N4"] == "" and titled[2, "N5"] == "" and titled[1, "EMPTY_NEWS_ID"] == ""
    assert as_rows(lookup.missing_keys(shown, lookup.with_empty_news(news), "news_id")) == [("N5", 1), ("N6", 1), ("N7", 1)]
    with pytest.raises(KeyError, match="N5"):
        lookup.candidate_titles(shown, news, strict=True)


def test_history_titles_keep_their_order(spark, parsed):
    news = spark.createDataFrame([("N1", "one"), ("N2", "two")], "news_id string, title string")
    got = {r[0]: [x["title"] for x in r["history"]] for r in lookup.history_titles(parsed, news, 3).collect()}
    assert got == {1: ["one", "two", ""], 2: ["", "", ""], 3: ["", "", ""], 4: ["one", "", ""]}


def test_descriptions_by_subcategory(spark, as_rows):
    news = spark.createDataFrame([("N1", "s1", "t1"), ("N2", "s2", "t2")], "news_id string, subcategory string, title string")
    descriptions = spark.createDataFrame([("s1", "about s1")], "category string, description string")
    assert as_rows(lookup.attach_description(news, descriptions)) == [("N1", "t1", "about s1"), ("N2", "t2", "")]
    with pytest.raises(KeyError, match="s2"):
        lookup.attach_description(news, descriptions, strict=True)
