"""Intermediate tables, and sessions that are started from another folder."""

import os
import subprocess
import sys
from pathlib import Path

from clickrank import session

REPO = Path(__file__).resolve().parents[1]


def test_staged_tables_go_with_clean_up(spark):
    staged = session.stage(spark.range(3).toDF("x"), "kept")
    assert staged.count() == 3
    folder = Path(session.scratch_folder(spark).removeprefix("file:"))
    assert any(folder.iterdir())
    with session.scratch(spark):
        pass
    assert not folder.exists()
    assert session.stage(spark.range(2).toDF("x"), "again").count() == 2


def test_the_entry_runs_from_another_folder(tmp_path):
    code = f"""
import sys
sys.path.append({str(REPO)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__
print("rows", __spark_entry__.entry(spark).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 1" in done.stdout, done.stderr[-2000:]
