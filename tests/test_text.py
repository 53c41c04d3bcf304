import random

import pytest
from pyspark.sql import functions as F

from clickrank.functions.tokens import first_tokens, pair_budgets, token_count, tokens
from clickrank.operators import text
from clickrank.plans.descriptions import describe_categories, description_statistics


@pytest.fixture(scope="module")
def docs(spark):
    data = [("d1", "the cat  sat\n", "on the mat"), ("d2", " the\tdog", None), ("d3", "", "the the the end"), ("d4", None, None)]
    return spark.createDataFrame(data, "news_id string, title string, body string")


def trim(a, b, budget):
    """Takes one token at a time off the longer side, off the first one on a tie."""
    while a + b > budget:
        if a >= b:
            a -= 1
        else:
            b -= 1
    return a, b


def test_pair_budgets_trim_the_longer_side(spark):
    pairs = [(a, b) for a in range(14) for b in range(14)]
    df = spark.createDataFrame(pairs, "a int, b int")
    for budget in (0, 1, 5, 6, 11):
        keep_a, keep_b = pair_budgets(F.col("a"), F.col("b"), budget)
        for a, b, x, y in df.select("a", "b", keep_a, keep_b).collect():
            want = trim(a, b, budget)
            if a > b and min(a, b) > budget // 2:
                want = (budget - budget // 2, budget // 2)  # both long: the odd token goes to the longer side
            assert (x, y) == want, (a, b, budget)


def test_tokens(spark, docs):
    got = {r["news_id"]: r["t"] for r in docs.select("news_id", tokens(F.col("title")).alias("t")).collect()}
    assert got == {"d1": ["the", "cat", "sat"], "d2": ["the", "dog"], "d3": [], "d4": None}
    counts = {r[0]: r[1] for r in docs.select("news_id", token_count(F.col("title"))).collect()}
    assert counts == {"d1": 3, "d2": 2, "d3": 0, "d4": 0}
    letters = {r[0]: r[1] for r in docs.select("news_id", token_count(F.col("title"), list)).collect()}
    assert letters == {"d1": 13, "d2": 8, "d3": 0, "d4": 0}


def test_first_tokens_are_the_first_of_all_tokens(spark):
    rng = random.Random(1)
    data = [("".join(rng.choice("ab \t\n") for _ in range(rng.randrange(40))),) for _ in range(300)]
    df = spark.createDataFrame(data, "s string")
    for n in (1, 2, 5, 50):
        assert df.where(first_tokens(F.col("s"), n) != F.slice(tokens(F.col("s")), 1, n)).count() == 0


def test_vocab(docs, as_rows):
    vocab = text.build_vocab(docs.select(F.concat_ws(" ", "title", "body").alias("t")), "t")
    ids = {r["token"]: (r["n"], r["id"]) for r in vocab.collect()}
    assert ids["the"] == (6, 4)
    assert [t for t, _ in sorted(ids.items(), key=lambda x: x[1][1])] == ["the", "cat", "dog", "end", "mat", "on", "sat"]
    assert set(r["token"] for r in text.build_vocab(docs, "body", min_count=2).collect()) == {"the"}
    assert text.build_vocab(docs, "body", size=2).count() == 2


def test_encoding(spark, docs):
    vocab = spark.createDataFrame([("the", 4), ("cat", 5), ("mat", 6), ("on", 7)], "token string, id long")
    single = {r["news_id"]: (r["input_ids"], r["n_ids"]) for r in text.encode_texts(docs, "news_id", "title", vocab, 4).collect()}
    assert single == {
        "d1": ([2, 4, 5, 3], 4), "d2": ([2, 4, 1, 3], 4), "d3": ([2, 3, 0, 0], 2), "d4": ([2, 3, 0, 0], 2),
    }
    pairs = text.encode_text_pairs(docs, "news_id", "title", "body", vocab, 7)
    double = {r["news_id"]: (r["input_ids"], r["n_ids"]) for r in pairs.collect()}
    assert double == {
        "d1": ([2, 4, 5, 3, 7, 4, 3], 7), "d2": ([2, 4, 1, 3, 3, 0, 0], 5), "d3": ([2, 3, 4, 4, 4, 1, 3], 7),
        "d4": ([2, 3, 3, 0, 0, 0, 0], 3),
    }


def test_news_text_methods(spark, as_rows):
    news = spark.createDataFrame([("N1", "s1", "t1"), ("N2", "s2", "t2")], "news_id string, subcategory string, title string")
    generated = spark.createDataFrame([("s1", "about s1"), ("s2", "about s2")], "category string, description string")
    assert as_rows(text.news_text(news, "none")) == [("N1", "t1"), ("N2", "t2")]
    templated = [("N1", "t1", "The category is s1"), ("N2", "t2", "The category is s2")]
    assert as_rows(text.news_text(news, "template_based")) == templated
    assert as_rows(text.news_text(news, "template_based", generated, strict=True)) == templated
    for method in text.GENERATED:
        assert as_rows(text.news_text(news, method, generated, strict=True))[0] == ("N1", "t1", "about s1")
    with pytest.raises(ValueError, match="unknown"):
        text.news_text(news, "other")
    with pytest.raises(ValueError, match="table"):
        text.news_text(news, "gpt4")
    with pytest.raises(KeyError):
        text.news_text(news, "template_based", generated.where("category = 's1'"), strict=True)


def test_generation_asks_only_failures_again(spark, tmp_path):
    log = tmp_path / "asked"

    def flaky(system_prompt, user_prompt):
        with open(log, "a") as f:
            f.write(user_prompt + "\n")
        name = user_prompt.split()[-1]
        asked = log.read_text().splitlines().count(user_prompt)
        if name == "never" or (name == "second" and asked < 2):
            raise ValueError(f"no answer for {name}")
        return f"{name} it is"

    categories = spark.createDataFrame([("first",), ("second",), ("never",)], "category string")
    got = {r["category"]: (r["description"], r["error"]) for r in text.generate_descriptions(text.generation_prompts(categories, "be brief"), flaky, 3).collect()}
    assert got == {"first": ("first it is", None), "second": ("second it is", None), "never": (None, "no answer for never")}
    asked = log.read_text().splitlines()
    assert sorted(asked) == sorted(
        ["The news category is first"] + 2 * ["The news category is second"] + 3 * ["The news category is never"]
    )


def test_description_plan(spark, tmp_path, as_rows):
    train = spark.createDataFrame([("c", "a"), ("c", "b")], "category string, subcategory string")
    val = spark.createDataFrame([("c", "b"), ("d", "x")], "category string, subcategory string")
    stored = describe_categories(train, val, lambda system, user: "words about " + user[-1], str(tmp_path / "d"), "be brief")
    assert as_rows(stored) == [(c, f"words about {c}") for c in "abx"]
    assert as_rows(text.unique_categories(train, val, "category")) == [("c",), ("d",)]

    def refuse(system, user):
        raise ValueError("no")

    with pytest.raises(RuntimeError, match="a"):
        describe_categories(train, val, refuse, str(tmp_path / "e"), "be brief", max_attempts=2)


def test_description_statistics(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text('[{"category": "a", "description": "one two three"}, {"category": "b", "description": "four"}]')
    assert tuple(description_statistics(spark, str(path)).first()) == (2, 3, 1, 2.0)
    path.write_text("[]")
    assert tuple(description_statistics(spark, str(path)).first()) == (0, None, None, None)
