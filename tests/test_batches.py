"""Batches as files: a round trip, and one file for one batch."""

import pytest
from pyspark.sql import functions as F

from clickrank.operators.sampling import assign_batches
from clickrank.sources import batches


@pytest.fixture(scope="module")
def examples(spark):
    return spark.range(1000).select(F.col("id").alias("impression_id"), F.array(F.col("id"), F.col("id") + 1).alias("history")).repartition(6)


@pytest.fixture(scope="module")
def written(spark, examples, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("batches") / "b")
    batches.write_batches(examples, path, batch_size=32, seed=7, epoch=2, batches_per_file=5)
    return path


def test_round_trip(spark, examples, written, as_rows):
    want = assign_batches(examples, 32, 7, 2)
    assert as_rows(batches.read_batches(spark, written).select(*want.columns)) == as_rows(want)


def test_a_batch_opens_one_file(spark, written):
    ids = set()
    for batch in (0, 4, 5, 17, 31):
        found = batches.read_batch(spark, written, batch)
        assert len(found.inputFiles()) == 1
        rows = found.collect()
        assert [r["place"] for r in rows] == list(range(32 if batch < 31 else 8))
        assert {r["batch"] for r in rows} == {batch}
        ids |= {r["impression_id"] for r in rows}
    assert len(ids) == 4 * 32 + 8


def test_the_index_names_every_file_once(spark, written):
    index = sorted(batches.batch_index(spark, written).collect(), key=lambda r: r["first"])
    assert [(r["first"], r["last"]) for r in index] == [(i, min(i + 4, 31)) for i in range(0, 32, 5)]
    assert sum(r["rows"] for r in index) == 1000
    assert {r["file"].rpartition("/")[2] for r in index} == {f.rpartition("/")[2] for f in batches.read_batches(spark, written).inputFiles()}


def test_filter_of_a_batch_reaches_the_scan(spark, written, executed_plan):
    assert "EqualTo(batch,3)" in executed_plan(batches.read_batch(spark, written, 3))


def test_defined_cases(spark, examples, written, tmp_path):
    with pytest.raises(IndexError, match="batch 32"):
        batches.read_batch(spark, written, 32)
    batches.write_batches(examples.limit(0), str(tmp_path / "none"), 32, 7)
    assert batches.batch_index(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(IndexError):
        batches.read_batch(spark, str(tmp_path / "none"), 0)
    with pytest.raises(Exception, match="already exists"):
        batches.write_batches(examples, written, 32, 7)
