"""Parsing and reshaping of news and impression tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickrank.functions.arrays import append_empty_candidate, parse_history, parse_impressions, positions
from clickrank.schema import ENTITY_COLUMNS


def drop_entities(news: DataFrame) -> DataFrame:
    """P1."""
    return news.drop(*ENTITY_COLUMNS)


def parse_behaviors(lines: DataFrame, strict: bool = False) -> DataFrame:
    """Packed strings to arrays, in the final column order.

    ``strict`` makes the query fail on an item without a label; otherwise the label is NULL.
    """
    parsed = parse_impressions(F.col("impressions_str"))
    if strict:
        unlabelled = F.exists(parsed, lambda x: x["clicked"].isNull())
        message = F.concat(F.lit("impression with an unlabelled candidate: "), F.col("impression_id").cast("string"))
        parsed = F.when(unlabelled, F.raise_error(message).cast(_CANDIDATES)).otherwise(parsed)
    return lines.select(
        "impression_id",
        "user_id",
        "time",
        parse_history(F.col("history_str")).alias("history"),
        parsed.alias("impressions"),
    )


_CANDIDATES = "array<struct<news_id:string,clicked:int>>"


def click_positions(behaviors: DataFrame) -> DataFrame:
    """P5: two array columns with the positions of clicked and unclicked candidates."""
    return behaviors.select(
        "*",
        positions(F.col("impressions"), 1).alias("clicked_idxes"),
        positions(F.col("impressions"), 0).alias("non_clicked_idxes"),
    )


def explode_candidates(behaviors: DataFrame, include_empty: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """P6 (and P7 with ``include_empty``): one row per shown news with its position and label."""
    shown = F.col("impressions")
    if include_empty:
        shown = append_empty_candidate(shown)
    return behaviors.select("impression_id", *keep, F.posexplode(shown).alias("pos", "_item")).select(
        "impression_id", *keep, "pos", "_item.news_id", "_item.clicked"
    )


def all_match(df: DataFrame, predicate: Column) -> DataFrame:
    """One row, true when every row satisfies the predicate; true for an empty table."""
    return df.agg(F.coalesce(F.bool_and(predicate), F.lit(True)).alias("all_match"))


def uniq(df: DataFrame, *columns: str) -> DataFrame:
    """P12."""
    return df.select(*columns).distinct()


def row_count(df: DataFrame) -> DataFrame:
    """A6."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def click_stats(behaviors: DataFrame, npratio: int) -> DataFrame:
    """Clicked and unclicked candidates per impression, and what makes it hard to sample from.

    Each row already holds its whole candidate list, so nothing is shuffled.
    """
    counted = behaviors.select(
        "impression_id",
        F.size(positions(F.col("impressions"), 1)).alias("n_clicked"),
        F.size(positions(F.col("impressions"), 0)).alias("n_unclicked"),
    )
    return counted.select(
        "*",
        (F.col("n_clicked") == 0).cast("int").alias("no_positive"),
        (F.col("n_unclicked") < npratio).cast("int").alias("few_negatives"),
    )
