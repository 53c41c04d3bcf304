"""Session defaults and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}
_shipped: set[str] = set()


def local_session(cores: int = 8, app: str = "clickrank", **conf: str) -> SparkSession:
    """Session for tests and benchmarks on one machine; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        # Small tables, much work per row: do not merge parts below the number of cores.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for name, value in conf.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for written intermediates: ``spark.checkpoint.dir``, or a temporary one in local mode only."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.conf.get("spark.app.id", "local")
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="clickrank-")
    return _local_folders[app]


def scratch_folder(spark: SparkSession) -> str:
    """All intermediate tables of this application are below it."""
    return f"{shared_folder(spark)}/clickrank/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Remove the intermediate tables of this application; DataFrames that read them end with it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[SparkSession]:
    """``with scratch(spark): ...`` removes the intermediate tables at the end of a run."""
    try:
        yield spark
    finally:
        clean_up(spark)


def ship_package(spark: SparkSession, *packages: str) -> None:
    """Send packages beside this one to the workers, once per application, so that jobs run from any folder."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="clickrank-")) / "clickrank-packages.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for package in ("clickrank", *packages):
            for file in sorted((root / package).rglob("*.py")):
                out.write(file, file.relative_to(root))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage durably: later reads see the same rows even when executors are lost, which a
    sampled range partitioning or an external call would not guarantee on recomputation.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
