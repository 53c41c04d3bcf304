"""Old versions of a materialized table: kept while a reader may hold them, removed afterwards."""

import time

import pytest
from pyspark.sql import functions as F

from clickrank.sources import cache

calls = []


def doubled(spark, path):
    calls.append(path)
    return spark.read.parquet(path).select((F.col("id") * 2).alias("x"))


def broken(spark, path):
    return spark.read.parquet(path).select(F.raise_error(F.lit("no")).alias("x"))


@pytest.fixture
def world(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    calls.clear()
    return str(tmp_path / "in"), str(tmp_path / "cache")


def refreshed(spark, world, times):
    path, root = world
    return [cache.materialize(spark, doubled, path, root=root, clear_cache=i > 0) for i in range(times)]


def versions(spark, root):
    folder = cache._Folder(spark, root)
    return {key: sorted(folder.names(key)) for key in folder.names() if not key.endswith(cache.MARKERS)}


def test_a_reader_across_refreshes(spark, world):
    first, second, third = refreshed(spark, world, 3)
    (key, held), = versions(spark, world[1]).items()
    assert len(held) == 3
    assert cache.clean_cache(spark, world[1], longest_read=3600) == cache.Removed((), (), 0)
    assert [df.count() for df in (first, second, third)] == [5, 5, 5]
    # The second version came 3600 s ago for all that is known; the first has no reader any more, nor has the second.
    removed = cache.clean_cache(spark, world[1], longest_read=3600, now=time.time() + 3700)
    assert removed.superseded == ((key, held[0]), (key, held[1])) and removed.unfinished == () and removed.markers == 2
    assert versions(spark, world[1]) == {key: held[2:]}
    assert third.count() == 5
    assert cache.materialize(spark, doubled, world[0], root=world[1]).count() == 5 and len(calls) == 3
    assert cache.clean_cache(spark, world[1], longest_read=0, now=time.time() + 9e9) == cache.Removed((), (), 0)


def test_a_version_is_held_as_long_as_it_was_handed_out(spark, world, monkeypatch):
    refreshed(spark, world, 3)
    (key, held), = versions(spark, world[1]).items()
    marked = cache._markers_of(spark, world[1], key)
    at = dict(zip(held, (1000.0, 2000.0, 3000.0)))
    monkeypatch.setattr(cache, "_markers_of", lambda *a: {v: (at[v], files) for v, (_, files) in marked.items()})
    # The first version was handed out until 2000, the second until 3000.
    assert cache.clean_cache(spark, world[1], longest_read=500, now=2400.0).superseded == ()
    assert cache.clean_cache(spark, world[1], longest_read=500, now=2600.0).superseded == ((key, held[0]),)


def test_an_interrupted_clean_up_is_finished_by_the_next(spark, world, monkeypatch):
    refreshed(spark, world, 3)
    (key, held), = versions(spark, world[1]).items()
    delete, deleted = cache._Folder.delete, []

    def dies(self, name):
        if len(deleted) == 3:
            raise OSError("gone")
        deleted.append(name)
        delete(self, name)

    later = time.time() + 100
    monkeypatch.setattr(cache._Folder, "delete", dies)
    with pytest.raises(OSError):
        cache.clean_cache(spark, world[1], longest_read=10, now=later)
    monkeypatch.setattr(cache._Folder, "delete", delete)
    assert deleted[:2] == [n for n in deleted[:2] if cache.MARKERS in n]  # markers first
    assert len(versions(spark, world[1])[key]) == 2
    assert cache.materialize(spark, doubled, world[0], root=world[1]).count() == 5 and len(calls) == 3
    removed = cache.clean_cache(spark, world[1], longest_read=10, now=later)
    assert len(removed.unfinished) == 1 and removed.superseded == ()
    assert versions(spark, world[1]) == {key: held[2:]}
    assert cache.materialize(spark, doubled, world[0], root=world[1]).count() == 5 and len(calls) == 3


def test_an_unfinished_version_stays_while_it_may_be_computed(spark, world):
    with pytest.raises(Exception, match="no"):
        cache.materialize(spark, broken, world[0], root=world[1])
    (key, held), = versions(spark, world[1]).items()
    assert len(held) == 1
    assert cache.clean_cache(spark, world[1], longest_read=0, longest_run=3600).unfinished == ()
    assert cache.clean_cache(spark, world[1], longest_read=0, longest_run=3600, now=time.time() + 3700).unfinished == ((key, held[0]),)
    assert versions(spark, world[1])[key] == []


def test_markers_that_vanish_are_looked_up_again(spark, world, monkeypatch):
    refreshed(spark, world, 1)
    (key, held), = versions(spark, world[1]).items()
    assert cache.newest_version(spark, world[1], key) == held[0]
    assert cache.newest_version(spark, world[1], "unknown") is None


def test_an_empty_cache(spark, tmp_path):
    assert cache.clean_cache(spark, str(tmp_path / "none"), longest_read=0) == cache.Removed((), (), 0)
