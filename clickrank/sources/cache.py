"""A computed table kept as Parquet under a key of its function, arguments and input files.

Below ``root`` a key has a folder of versions and a folder of markers, which name the complete versions; the newest one
counts. ``clean_cache`` removes versions that no reader can hold any more.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKER_SCHEMA = "version string, rows long"
MARKERS = ".complete"
RETRIES = 5


def input_fingerprint(spark: SparkSession, path: str) -> list:
    """Files, bytes and newest change of the input. Only the listing is read, not the contents."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .select("path", "length", "modificationTime")
    )
    n, size, state = files.agg(
        F.count(F.lit(1)), F.sum("length"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))
    ).first()
    return [n, size, state]


def materialize(
    spark: SparkSession,
    fn: Callable[..., DataFrame],
    path: str,
    *args,
    root: str,
    clear_cache: bool = False,
    **kwargs,
) -> DataFrame:
    """Result of ``fn(spark, path, *args, **kwargs)``, computed once per key and read from Parquet afterwards.

    The key changes with the arguments (values that JSON can write) and with any input file, so a changed input is never
    served stale. Every computation goes to a folder of its own, and the marker that names it is written last: a failed
    or interrupted one leaves the last complete result in force.
    """
    described = [f"{fn.__module__}.{fn.__qualname__}", path, args, sorted(kwargs.items()), input_fingerprint(spark, path)]
    key = hashlib.sha256(json.dumps(described).encode()).hexdigest()
    if not clear_cache:
        found = newest_version(spark, root, key)
        if found:
            return spark.read.parquet(f"{root}/{key}/{found}")
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    table = f"{root}/{key}/{version}"
    fn(spark, path, *args, **kwargs).write.parquet(table)
    done = spark.read.parquet(table)
    marker = done.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(version).alias("version"), "rows")
    marker.coalesce(1).write.mode("append").parquet(f"{root}/{key}{MARKERS}")
    return done


def newest_version(spark: SparkSession, root: str, key: str) -> str | None:
    """Versions are named by time, so that the newest complete one counts.

    Markers that a clean-up removes while they are read are looked up again; the newest one it never removes.
    """
    for attempt in range(RETRIES):
        try:
            return spark.read.schema(MARKER_SCHEMA).parquet(f"{root}/{key}{MARKERS}").agg(F.max("version")).first()[0]
        except AnalysisException:
            return None
        except (PySparkException, Py4JJavaError):
            if attempt == RETRIES - 1:
                raise
    return None


# ---------------------------------------------------------------- retention


@dataclass(frozen=True)
class Removed:
    """What a clean-up took away: (key, version) of superseded and of unfinished tables, and the number of markers."""

    superseded: tuple[tuple[str, str], ...]
    unfinished: tuple[tuple[str, str], ...]
    markers: int


def _started(version: str) -> float:
    """Seconds since the epoch at which the computation of a version began, which its name says."""
    return int(version.partition("-")[0]) / 1e9


class _Folder:
    """Names, ages and deletion below ``root``, in whatever store it is."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, name: str = "") -> dict[str, float]:
        """Entries with the time of their last change, in seconds."""
        if not self.fs.exists(self._path(name)):
            return {}
        listed = self.fs.listStatus(self._path(name))
        return {s.getPath().getName(): s.getModificationTime() / 1e3 for s in listed}

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def _markers_of(spark: SparkSession, root: str, key: str) -> dict[str, tuple[float, set[str]]]:
    """Version -> (when it was first marked complete, the marker files that name it)."""
    rows = spark.read.schema(MARKER_SCHEMA).parquet(f"{root}/{key}{MARKERS}").select(
        "version", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").cast("double").alias("at")
    )
    found: dict[str, tuple[float, set[str]]] = {}
    for r in rows.collect():  # one row per complete version of a key
        at, files = found.get(r["version"], (r["at"], set()))
        found[r["version"]] = (min(at, r["at"]), files | {r["file"]})
    return found


def clean_cache(spark: SparkSession, root: str, longest_read: float, longest_run: float | None = None, now: float | None = None) -> Removed:
    """Removes versions that nobody can be reading, and compacts the markers of their keys.

    ``longest_read`` is the caller's bound, in seconds, on how long a table from ``materialize`` is in use. A version
    is handed out until a newer one is marked complete; it goes once that is longer ago. A version without a
    marker is unfinished; it goes when it began more than ``longest_run`` seconds ago (``longest_read`` unless given).
    The newest complete version of a key always stays.

    Markers go before the data that they name, and data without a marker is found by the next call, so an interrupted
    call leaves no marker without its table, and the next one finishes the work. One clean-up at a time.
    """
    now = time.time() if now is None else now
    longest_run = longest_read if longest_run is None else longest_run
    folder = _Folder(spark, root)
    superseded, unfinished, removed = [], [], 0
    tops = folder.names()
    for key in sorted(n for n in tops if not n.endswith(MARKERS)):
        marked = _markers_of(spark, root, key) if f"{key}{MARKERS}" in tops else {}
        complete = sorted(marked)
        old = [v for v, newer in zip(complete, complete[1:]) if now - max(marked[v][0], marked[newer][0]) > longest_read]
        kept = {f for v in complete if v not in old for f in marked[v][1]}
        for file in sorted({f for v in old for f in marked[v][1]} - kept):
            folder.delete(f"{key}{MARKERS}/{file}")
            removed += 1
        for version in folder.names(key):
            if version in old:
                superseded.append((key, version))
            elif version not in marked and now - _started(version) > longest_run:
                unfinished.append((key, version))
            else:
                continue
            folder.delete(f"{key}/{version}")
    return Removed(tuple(superseded), tuple(unfinished), removed)
