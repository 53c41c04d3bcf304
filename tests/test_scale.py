import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from clickrank.operators import scale


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of the rows, another is null."""
    rng = random.Random(3)
    data = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else (None if i % 10 == 1 else f"k{rng.randrange(60)}")
        data.append((key, i, rng.randrange(5)))
    return spark.createDataFrame(data, "k string, i int, v int").repartition(6)


def test_hot_groups_finds_only_large_ones(skewed, as_rows):
    assert scale.hot_groups(skewed, ["k"]) is None
    assert as_rows(scale.hot_groups(skewed, ["k"], limit=100)) == [("hot",)]
    assert as_rows(scale.hot_groups(skewed, ["k"], limit=50)) == [(None,), ("hot",)]


def test_hot_groups_of_nothing(spark):
    assert scale.hot_groups(spark.createDataFrame([], "k string"), ["k"]) is None


@pytest.mark.parametrize("limit", [1, 20, 50, 100, 10_000])
def test_number_rows_is_row_number_for_any_limit(skewed, as_rows, limit):
    order = [F.col("v").desc(), F.col("i").asc()]
    window = Window.partitionBy("k").orderBy(*order)
    want = skewed.withColumn("n", F.row_number().over(window).cast("long") - 1)
    got = scale.number_rows(skewed, ["k"], order, "n", start=0, limit=limit)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert as_rows(got) == as_rows(want)


def test_dense_index_runs_through_all_parts(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("x")).repartition(7)
    indexed = scale.dense_index(df, [F.col("x").desc()], "n", start=10).orderBy("n").collect()
    assert [r["n"] for r in indexed] == list(range(10, 5010))
    assert [r["x"] for r in indexed] == sorted((r["x"] for r in indexed), reverse=True)


def test_dense_index_of_nothing(spark):
    assert scale.dense_index(spark.createDataFrame([], "x int"), [F.col("x").asc()], "n").count() == 0


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_gives_the_same_rows_every_way(spark, skewed, as_rows, how):
    dim = spark.createDataFrame([("hot", 1.0)] + [(f"k{i}", float(i)) for i in range(0, 60, 2)], "k string, w double")
    want = as_rows(skewed.join(dim, "k", how))
    assert as_rows(scale.lookup(skewed, dim, "k", how)) == want
    assert as_rows(scale.lookup(skewed, dim, "k", how, broadcast_bytes=0)) == want
    assert as_rows(scale.lookup(skewed, dim, "k", how, broadcast_bytes=0, limit=40)) == want
    assert as_rows(scale.lookup(skewed, dim, "k", how, derived=True)) == want


def test_lookup_salts_where_skew_is_not_split_at_run_time(spark, skewed, as_rows, executed_plan):
    dim = spark.createDataFrame([("hot", 1.0), ("k1", 2.0)], "k string, w double")
    want = as_rows(skewed.join(dim, "k", "left"))
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        salted = scale.lookup(skewed, dim, "k", derived=True, limit=100)
        assert "_salt" in executed_plan(salted)
        assert as_rows(salted) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.skewJoin.enabled")


def test_lookup_refuses_other_joins(spark, skewed):
    with pytest.raises(ValueError, match="full"):
        scale.lookup(skewed, skewed, "k", "full")


def test_small_dimension_is_broadcast_and_large_one_is_not(spark, skewed, executed_plan):
    dim = spark.range(10).select(F.col("id").cast("string").alias("k"))
    assert "BroadcastHashJoin" in executed_plan(scale.lookup(skewed, dim, "k"))
    assert scale.measured_bytes(dim) >= 10


def test_measured_bytes_grows_with_content(spark):
    def size(n):
        df = spark.range(1).select(
            F.repeat(F.lit("x"), n).alias("s"), F.array_repeat(F.lit(1.0), n).alias("a"),
            F.array_repeat(F.repeat(F.lit("y"), 10), n).alias("t"),
            F.array_repeat(F.struct(F.lit("z").alias("q")), n).alias("u"),
        )
        return scale.measured_bytes(df)

    assert size(1000) >= 1000 * (1 + 8 + 10 + 1)
    assert size(1000) > 50 * size(1)


def test_spread_only_moves_too_few_parts(spark, executed_plan):
    assert scale.spread(spark.range(100, numPartitions=1)).rdd.getNumPartitions() >= 4
    assert "Exchange" not in executed_plan(scale.spread(spark.range(100, numPartitions=16)))


def test_shared_folder_must_be_named_on_a_cluster(monkeypatch):
    from clickrank.session import shared_folder

    class Conf:
        def __init__(self, values):
            self.values = values

        def get(self, name, default=None):
            return self.values.get(name, default)

    class Session:
        def __init__(self, **values):
            self.conf = Conf({k.replace("_", "."): v for k, v in values.items()})

    assert shared_folder(Session(spark_checkpoint_dir="hdfs:///x/", spark_master="yarn")) == "hdfs:///x"
    with pytest.raises(RuntimeError):
        shared_folder(Session(spark_master="yarn"))
    local = Session(spark_master="local[2]", spark_app_id="a")
    assert shared_folder(local) == shared_folder(local)
