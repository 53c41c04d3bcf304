"""Tab-separated news and impression logs, description files, split layout."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickrank.operators.behaviors import drop_entities, parse_behaviors
from clickrank.schema import BEHAVIOR_FILE, DESCRIPTION_FILE, NA_TOKENS, NEWS_FILE

# The splits of each dataset size.
SPLITS = {"small": ("train", "val"), "large": ("train", "val", "test")}


def read_news(
    spark: SparkSession, path: str, has_entities: bool = False, na_tokens: Sequence[str] = NA_TOKENS
) -> DataFrame:
    """Headerless news TSV. A field that begins with a quote ends at the matching one; doubled quotes are
    literal. An unbalanced quote damages its own line only (see ``damaged_news``)."""
    raw = spark.read.csv(
        path, schema=NEWS_FILE, sep="\t", quote='"', escape='"', encoding="UTF-8", multiLine=False, mode="PERMISSIVE"
    )
    if na_tokens:
        missing = list(na_tokens)
        raw = raw.select(*[F.when(~F.col(c).isin(missing), F.col(c)).alias(c) for c in raw.columns])
    return raw if has_entities else drop_entities(raw)


def damaged_news(news: DataFrame) -> DataFrame:
    """Lines whose fields ran together because of an unbalanced quote: their url is missing."""
    return news.where(F.col("url").isNull())


def read_behavior_lines(spark: SparkSession, path: str) -> DataFrame:
    """S2, scan part: the five raw columns. Quotes are ordinary characters; bad bytes become U+FFFD."""
    return spark.read.csv(path, schema=BEHAVIOR_FILE, sep="\t", quote="", encoding="UTF-8", mode="PERMISSIVE")


def read_behaviors(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """The parsed impression table."""
    return parse_behaviors(read_behavior_lines(spark, path), strict=strict)


def read_descriptions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """S3: category descriptions from a JSON array, or from JSON lines as ``write_descriptions`` makes them.
    Of a repeated category the last entry counts."""
    raw = spark.read.schema(DESCRIPTION_FILE).json(path, multiLine=not lines)
    where = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start")]
    place = F.struct(*where, F.monotonically_increasing_id())
    placed = raw.select("category", "description", place.alias("_place"))
    return placed.groupBy("category").agg(F.max_by("description", "_place").alias("description"))


def write_descriptions(descriptions: DataFrame, path: str) -> None:
    """One JSON object per line, written by all tasks."""
    descriptions.select("category", "description").write.mode("overwrite").json(path)


def read_split(spark: SparkSession, root: str, size: str, split: str, table: str = "behaviors") -> DataFrame:
    """One table of one split of ``{root}/{size}/{split}/``, tagged with both names."""
    if split not in SPLITS.get(size, ()):
        raise ValueError(f"unknown split {size}/{split}")
    path = f"{root}/{size}/{split}/{table}.tsv"
    rows = read_news(spark, path) if table == "news" else read_behaviors(spark, path)
    return rows.select(F.lit(size).alias("size"), F.lit(split).alias("split"), "*")


def read_splits(
    spark: SparkSession,
    root: str,
    table: str = "behaviors",
    which: Iterable[tuple[str, str]] = tuple((size, split) for size, splits in SPLITS.items() for split in splits),
) -> DataFrame:
    """S6, several splits in one table; a filter on ``size`` or ``split`` drops the other reads."""
    return reduce(DataFrame.unionByName, [read_split(spark, root, size, split, table) for size, split in which])
