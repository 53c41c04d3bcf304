"""Skew-safe building blocks: numbering inside groups, dense indexes and dimension lookups.

A group is handled by one task only while it is known to be small. Larger groups are split by range
(numbering) or by salt (joins); both ways give the same rows as the plain window or join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickrank.session import stage

HOT_ROWS = 1_000_000          # a larger group is spread over several tasks
MAX_HOT_GROUPS = 100_000      # bound on the list of hot groups, which is broadcast
BROADCAST_BYTES = 64 << 20    # measured size up to which a dimension is broadcast
FAR_LARGER = 8                # times that many bytes of files are not measured
SALTS = 64                    # parts a hot join key is split into


def _width(dtype: T.DataType, col: Column) -> Column:
    """Bytes of one value, estimated from above for the types used here."""
    if isinstance(dtype, T.StringType):
        return F.coalesce(F.octet_length(col), F.lit(0)) + 16
    if isinstance(dtype, T.ArrayType):
        if isinstance(dtype.elementType, T.StringType):
            return F.coalesce(F.octet_length(F.array_join(col, "")) + 16 * F.size(col), F.lit(0)) + 16
        if isinstance(dtype.elementType, (T.ArrayType, T.StructType)):
            parts = F.transform(col, lambda x: _width(dtype.elementType, x))
            return F.coalesce(F.aggregate(parts, F.lit(0), lambda a, x: a + x.cast("int")), F.lit(0)) + 16
        return F.coalesce(8 * F.size(col), F.lit(0)) + 16
    if isinstance(dtype, T.StructType):
        return reduce(lambda a, b: a + b, [_width(f.dataType, col[f.name]) for f in dtype.fields], F.lit(16))
    return F.lit(16)


def measured_bytes(df: DataFrame) -> int:
    """Size of a table measured by one aggregate, not taken from optimizer estimates."""
    row = reduce(lambda a, b: a + b, [_width(f.dataType, F.col(f.name)) for f in df.schema.fields], F.lit(16))
    return int(df.agg(F.sum(row.cast("long"))).first()[0] or 0)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan over at least as many partitions as there are cores.

    A file with a single row group is read by one task however long the work on it; with enough files or row
    groups nothing is moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def hot_groups(df: DataFrame, keys: Sequence[str], limit: int = HOT_ROWS) -> DataFrame | None:
    """Keys whose group has more than ``limit`` rows, or None when there is none.

    Counts are combined on the map side. The list never exceeds ``MAX_HOT_GROUPS`` rows because the limit
    is raised to ``total / MAX_HOT_GROUPS`` if needed.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    largest, total = sizes.agg(F.max("_rows"), F.sum("_rows")).first()
    if largest is None or largest <= max(limit, total // MAX_HOT_GROUPS):
        return None
    limit = max(limit, total // MAX_HOT_GROUPS)
    hot = sizes.where(F.col("_rows") > limit).select(*[F.col(k).alias(f"_hot_{k}") for k in keys])
    return stage(hot, "hot-groups")


def split_hot(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of ordinary groups, rows of hot groups); null keys count as a group."""
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys])
    small = F.broadcast(hot)
    return df.join(small, match, "left_anti"), df.join(small, match, "left_semi")


def range_number(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, start: int = 1) -> DataFrame:
    """Number the rows of each group in ``order`` without putting a group into one task.

    Rows are range-partitioned by (keys, order) and written once; the number is the place inside the
    written part plus the count of the group's rows in earlier parts. ``order`` must not leave ties.
    """
    spark = df.sparkSession
    by = [F.col(k).asc() for k in keys] + list(order)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = stage(
        df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_row", F.monotonically_increasing_id()),
        "ranged",
    ).withColumn("_part", F.shiftright("_row", 33))
    # One row per part, plus one per group: bounded by the parts and the hot groups of the caller.
    earlier = Window.partitionBy(*([F.col(f"_key_{k}") for k in keys] or [F.lit(0)])).orderBy("_in_part")
    begins = (
        placed.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_part").alias("_in_part"))
        .agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_before",
            F.coalesce(F.sum("_n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        )
    )
    match = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys],
        F.col("_part") == F.col("_in_part"),
    )
    number = F.col("_row") - F.col("_first") + F.col("_before") + start
    return placed.join(F.broadcast(begins), match).select(*[F.col(c) for c in df.columns], number.alias(name))


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str,
    start: int = 1,
    bounded: bool = False,
    limit: int = HOT_ROWS,
) -> DataFrame:
    """``row_number`` per group, safe for groups of any size.

    ``bounded=True`` says the caller's groups are small by construction, which saves the counting pass.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    number = (F.row_number().over(window) + (start - 1)).cast("long").alias(name)
    hot = None if bounded else hot_groups(df, keys, limit)
    if hot is None:
        return df.select("*", number)
    ordinary, heavy = split_hot(df, hot, keys)
    return ordinary.select("*", number).unionByName(range_number(heavy, keys, order, name, start))


def dense_index(df: DataFrame, order: Sequence[Column], name: str, start: int = 1) -> DataFrame:
    """Consecutive numbers over the whole table in ``order``, without a global window."""
    return range_number(df, [], order, name, start)


def scanned_bytes(df: DataFrame) -> int | None:
    """Bytes of the files whose every row is in ``df``, from their listing, or None where rows are joined, filtered or made."""
    total, left = 0, [df._jdf.queryExecution().optimizedPlan()]
    while left:
        node = left.pop()
        if node.nodeName() in ("Project", "Union"):
            children = node.children()
            left += [children.apply(i) for i in range(children.size())]
        elif node.nodeName() == "Range":
            continue  # adds rows, and no bytes to a least size
        elif node.nodeName().startswith(("LogicalRelation", "Relation")):
            total += int(str(node.stats().sizeInBytes()))
        else:
            return None
    return total


def fits_broadcast(dim: DataFrame, limit: int | None = None) -> bool:
    """Is the measured size within the limit? Plain scans of far larger files are not measured, as they cannot be."""
    limit = BROADCAST_BYTES if limit is None else limit
    files = scanned_bytes(dim)
    if files is not None and files > FAR_LARGER * limit:
        return False
    return measured_bytes(dim) <= limit


def _splits_skew(spark: SparkSession) -> bool:
    return all(
        spark.conf.get(name, "true").lower() == "true"
        for name in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled")
    )


def lookup(
    fact: DataFrame,
    dim: DataFrame,
    keys: str | Sequence[str],
    how: str = "left",
    size_of: DataFrame | None = None,
    derived: bool = False,
    fits: bool | None = None,
    broadcast_bytes: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Equi-join of ``fact`` with a table unique on ``keys``.

    The dimension is broadcast when its measured size allows; ``size_of`` names a table of the same size that is
    cheaper to measure, and ``fits`` hands in a measurement already made (``fits_broadcast``). Otherwise both are shuffled
    in one join: the rows of hot fact keys are salted in place, and only their dimension rows are copied to each salt.

    ``derived=True`` is for a dimension that costs much to compute: measuring it would compute it twice, so both
    sides are shuffled and adaptive execution picks a broadcast from the real size or splits oversize partitions.
    Where a session has switched that off, hot keys are salted as above.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"lookup is a left or an inner join, not {how}")
    keys = [keys] if isinstance(keys, str) else list(keys)
    if derived:
        if _splits_skew(fact.sparkSession):
            return fact.join(dim, keys, how)
    elif fits_broadcast(dim if size_of is None else size_of, broadcast_bytes) if fits is None else fits:
        return fact.join(F.broadcast(dim), keys, how)
    hot = hot_groups(fact, keys, HOT_ROWS if limit is None else limit)
    if hot is None:
        return fact.join(dim, keys, how)
    listed = F.broadcast(hot.withColumn("_is_hot", F.lit(True)))
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys])
    salt = F.when(F.col("_is_hot"), F.pmod(F.xxhash64(*fact.columns), F.lit(SALTS))).otherwise(0)
    salted = fact.join(listed, match, "left").select(*fact.columns, salt.cast("int").alias("_salt"))
    salts = F.sequence(F.lit(0), F.when(F.col("_is_hot"), F.lit(SALTS - 1)).otherwise(0))
    copies = dim.join(listed, match, "left").select(*dim.columns, F.explode(salts).alias("_salt"))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")
