"""Reproducible random order from hashes, independent of partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_key(seed: int, epoch: int, *parts: Column | str) -> Column:
    """Hash of the seed, the epoch and what identifies the row; sorting by it is a uniform shuffle."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), *[c.cast("string") for c in columns]))
