import json

import pytest
from pyspark.sql import functions as F

from clickrank.sources import cache, files

NEWS = "\n".join(
    "\t".join(fields)
    for fields in [
        ("N1", "news", "newsus", "Plain title", "abs", "u1", "[]", "[]"),
        ("N2", "news", "newsus", '"Quoted ""inner"" title"', "abs", "u2", '[{"Label": "X", "Type": "P"}]', "[]"),
        ("N3", "news", "newsus", 'Mid "quote" title', "abs", "u3", "[]", "[]"),
        ("N4", "news", "NA", "null", "N/A", "u4", "[]", "[]"),
        ("N5", "news", "newsus", '"Unbalanced start', "abs", "u5", "[]", "[]"),
        ("N6", "news", "newsus", "Next line", "", "u6", "[]", "[]"),
    ]
)


@pytest.fixture
def news_file(tmp_path):
    path = tmp_path / "news.tsv"
    path.write_text(NEWS + "\n")
    return str(path)


def test_news(spark, news_file):
    news = files.read_news(spark, news_file)
    assert news.columns == ["news_id", "category", "subcategory", "title", "abstract", "url"]
    got = {r["news_id"]: r for r in news.collect()}
    assert set(got) == {f"N{i}" for i in range(1, 7)}
    assert got["N1"]["title"] == "Plain title"
    assert got["N2"]["title"] == 'Quoted "inner" title'
    assert got["N3"]["title"] == 'Mid "quote" title'
    assert (got["N4"]["subcategory"], got["N4"]["title"], got["N4"]["abstract"]) == (None, None, None)
    assert got["N6"]["title"] == "Next line" and got["N6"]["abstract"] is None
    assert [r["news_id"] for r in files.damaged_news(news).collect()] == ["N5"]


def test_news_options(spark, news_file):
    with_entities = files.read_news(spark, news_file, has_entities=True)
    assert with_entities.columns[-2:] == ["title_entities", "abstract_entities"]
    assert with_entities.where("news_id = 'N2'").first()["title_entities"] == '[{"Label": "X", "Type": "P"}]'
    raw = files.read_news(spark, news_file, na_tokens=()).where("news_id = 'N4'").first()
    assert (raw["subcategory"], raw["title"], raw["abstract"]) == ("NA", "null", "N/A")


def test_behaviors(spark, tmp_path):
    path = tmp_path / "behaviors.tsv"
    path.write_bytes(
        b'1\tU1\t11/11/2019 9:05:58 AM\tN1 N2\tN3-0 N4-1\n2\tU"2\t11/12/2019 6:11:30 PM\t\tN5-1 N6-0 N7-0\n3\tU\xff3\tt\tN1\tN3-1\n'
    )
    got = {r["impression_id"]: r for r in files.read_behaviors(spark, str(path), strict=True).collect()}
    assert got[1]["history"] == ["N1", "N2"] and got[1]["time"] == "11/11/2019 9:05:58 AM"
    assert got[2]["history"] is None and got[2]["user_id"] == 'U"2' and len(got[2]["impressions"]) == 3
    assert got[3]["user_id"] == "U�3"


def test_descriptions_keep_the_last(spark, tmp_path, as_rows):
    path = tmp_path / "d.json"
    path.write_text(json.dumps([{"category": c, "description": d} for c, d in [("a", "1"), ("b", "2"), ("a", "3")]], indent=4))
    assert as_rows(files.read_descriptions(spark, str(path))) == [("a", "3"), ("b", "2")]


def test_descriptions_round_trip(spark, tmp_path, as_rows):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([("a", 'with "quotes"\nand lines'), ("b", "é")], "category string, description string")
    files.write_descriptions(df, path)
    files.write_descriptions(df, path)
    assert as_rows(files.read_descriptions(spark, path, lines=True)) == as_rows(df)


def test_splits(spark, tmp_path, as_rows, executed_plan):
    for size, split in (("small", "train"), ("small", "val"), ("large", "train"), ("large", "val"), ("large", "test")):
        folder = tmp_path / size / split
        folder.mkdir(parents=True)
        (folder / "behaviors.tsv").write_text(f"1\tU{size}{split}\tt\t\tN1-0\n")
        (folder / "news.tsv").write_text(NEWS + "\n")
    everything = files.read_splits(spark, str(tmp_path))
    assert as_rows(everything.select("size", "split", "user_id")) == sorted(
        (s, p, f"U{s}{p}") for s, ps in files.SPLITS.items() for p in ps
    )
    assert files.read_split(spark, str(tmp_path), "small", "val", "news").count() == 6
    only = everything.where((F.col("size") == "small") & (F.col("split") == "val"))
    assert only.count() == 1 and executed_plan(only).count("FileScan") == 1
    with pytest.raises(ValueError):
        files.read_split(spark, str(tmp_path), "small", "test")


calls = []


def load(spark, path, factor=1):
    calls.append(factor)
    return spark.read.csv(path, schema="x int").select((F.col("x") * factor).alias("x"))


def test_materialize(spark, tmp_path, as_rows):
    path, root = tmp_path / "in.csv", str(tmp_path / "cache")
    path.write_text("1\n2\n")
    calls.clear()
    assert as_rows(cache.materialize(spark, load, str(path), root=root)) == [(1,), (2,)]
    assert as_rows(cache.materialize(spark, load, str(path), root=root)) == [(1,), (2,)]
    assert calls == [1]
    assert as_rows(cache.materialize(spark, load, str(path), 10, root=root)) == [(10,), (20,)]
    assert calls == [1, 10]
    cache.materialize(spark, load, str(path), root=root, clear_cache=True)
    assert calls == [1, 10, 1]
    path.write_text("1\n2\n3\n")
    assert as_rows(cache.materialize(spark, load, str(path), root=root)) == [(1,), (2,), (3,)]
    assert calls == [1, 10, 1, 1]


def test_a_failed_refresh_leaves_the_last_result(spark, tmp_path, as_rows):
    path, root = tmp_path / "in.csv", str(tmp_path / "cache")
    path.write_text("1\n2\n")
    state = {"fails": False}

    def fragile(spark, path):
        rows = spark.read.csv(path, schema="x int")
        return rows.select(F.raise_error(F.lit("broken")).cast("int").alias("x")) if state["fails"] else rows

    assert as_rows(cache.materialize(spark, fragile, str(path), root=root)) == [(1,), (2,)]
    state["fails"] = True
    with pytest.raises(Exception, match="broken"):
        cache.materialize(spark, fragile, str(path), root=root, clear_cache=True)
    assert as_rows(cache.materialize(spark, fragile, str(path), root=root)) == [(1,), (2,)]
    state["fails"] = False
    assert as_rows(cache.materialize(spark, fragile, str(path), root=root, clear_cache=True)) == [(1,), (2,)]
