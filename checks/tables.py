"""The given tables as news, impression and vector tables (see FIXTURES.md, and README.md for what differs)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickrank.operators.scale import HOT_ROWS, lookup, number_rows, spread
from clickrank.operators.users import build_user_index
from clickrank.session import stage

PAGE = 8                        # events of a user that one impression shows
LOOK_BACK = 10                  # pages before it whose clicks an impression logs as its history
BLOCK = 1_000                   # pages of a user that one task orders
USER_IDS = 1_000_000_000        # an impression id is the user's number times this plus the page
FIRST_VALIDATION_DAY = "2024-01-02"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_counts: dict[tuple[str, str], int] = {}


def n_rows(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Counted once per table, from the file footers."""
    if (sf_dir, name) not in _counts:
        _counts[sf_dir, name] = table(spark, sf_dir, name).count()
    return _counts[sf_dir, name]


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(user, user_id, ts, event_id, news_id, clicked)``: one row per event."""
    n_docs = n_rows(spark, sf_dir, "documents")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("user"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("user_id"),
        "ts",
        "event_id",
        F.concat(F.lit("N"), F.pmod("event_id", F.lit(n_docs)).cast("string")).alias("news_id"),
        F.col("event_type").isin("click", "purchase").cast("int").alias("clicked"),
    )


def shown_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log with ``impression_id``, ``page`` and ``pos``: an impression is a page of ``PAGE`` events of a user."""
    order = [F.col("ts").asc(), F.col("event_id").asc()]
    # No group is larger than the table, so a small table needs no count of its groups.
    small = n_rows(spark, sf_dir, "events") <= HOT_ROWS
    numbered = number_rows(event_log(spark, sf_dir), ["user_id"], order, "seq", 0, small, HOT_ROWS)
    page = F.floor(F.col("seq") / PAGE)
    return numbered.select(
        (F.col("user") * USER_IDS + page).alias("impression_id"),
        "user_id",
        page.alias("page"),
        "ts",
        "event_id",
        F.pmod("seq", F.lit(PAGE)).cast("int").alias("pos"),
        "news_id",
        "clicked",
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_news(spark, sf_dir).select("impression_id", "pos", "news_id", "clicked")


def with_history(pages: DataFrame) -> DataFrame:
    """``history`` of every page: the clicks of the user's ``LOOK_BACK`` preceding pages, in order; NULL without any.

    A user's pages are ordered in blocks, each with the last pages of the block before it as context, so that one
    user's pages are spread over tasks and a frame never holds more than ``LOOK_BACK`` pages.
    """
    block, place = F.floor(F.col("page") / BLOCK), F.pmod("page", F.lit(BLOCK))
    blocks = F.when(place >= BLOCK - LOOK_BACK, F.array(block, block + 1)).otherwise(F.array(block))
    frame = Window.partitionBy("user_id", "_block").orderBy("page").rowsBetween(-LOOK_BACK, -1)
    clicked = F.transform(F.filter("impressions", lambda x: x["clicked"] == 1), lambda x: x["news_id"])
    placed = pages.withColumn("_clicks", clicked).withColumn("_block", F.explode(blocks))
    framed = placed.withColumn("_past", F.flatten(F.collect_list("_clicks").over(frame))).where(F.col("_block") == block)
    return framed.select(*pages.columns, F.when(F.size("_past") > 0, F.col("_past")).alias("history"))


def dated_behaviors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parsed impression table with its day; one row per impression."""
    pages = shown_news(spark, sf_dir).groupBy("impression_id", "user_id", "page").agg(
        F.min("ts").alias("_first"), F.array_sort(F.collect_list(F.struct("pos", "news_id", "clicked"))).alias("items")
    )
    items = F.transform("items", lambda x: F.struct(x["news_id"].alias("news_id"), x["clicked"].alias("clicked")))
    listed = pages.select("impression_id", "user_id", "page", "_first", items.alias("impressions"))
    return with_history(listed).select(
        "impression_id", "user_id", F.date_format("_first", "M/d/yyyy h:mm:ss a").alias("time"), "history", "impressions",
        F.to_date("_first").alias("day"),
    )


def behaviors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dated_behaviors(spark, sf_dir).drop("day")


def stored_behaviors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The impression table as a log that is on disk, for queries that read it more than once."""
    return stage(behaviors(spark, sf_dir), "behaviors")


def log_lines(behaviors: DataFrame) -> DataFrame:
    """Behaviours as the five columns of the log file, lists packed into strings."""
    packed = F.transform("impressions", lambda x: F.concat(x["news_id"], F.lit("-"), x["clicked"].cast("string")))
    return behaviors.select(
        "impression_id", "user_id", "time", F.array_join("history", " ").alias("history_str"),
        F.array_join(packed, " ").alias("impressions_str"),
    )


def train_val(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All impressions, the first day for training and the later days for validation."""
    dated = table(spark, sf_dir, "events").select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("user_id"), F.to_date("ts").alias("day")
    )
    first = F.col("day") < F.lit(FIRST_VALIDATION_DAY).cast("date")
    return dated.where(first).select("user_id"), dated.where(~first).select("user_id")


def user_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_user_index(*train_val(spark, sf_dir))


def one_line(text) -> F.Column:
    return F.translate(text, "\t\n", "  ")


def news(spark: SparkSession, sf_dir: str, spread_out: bool = False) -> DataFrame:
    """Documents as news: the title is the whole text on one line, the abstract the text as it is.

    ``spread_out`` is for work on every word of the texts.
    """
    text = F.col("text")
    title = one_line(text)
    docs = table(spark, sf_dir, "documents")
    return (spread(docs) if spread_out else docs).select(
        F.concat(F.lit("N"), F.col("doc_id").cast("string")).alias("news_id"),
        F.col("lang").alias("category"),
        F.col("source").alias("subcategory"),
        F.when(F.trim(title) != "", title).alias("title"),
        text.alias("abstract"),
        F.concat(F.lit("https://news.example/"), F.col("doc_id").cast("string")).alias("url"),
    )


def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per subcategory the whole text of its first document."""
    first = table(spark, sf_dir, "documents").groupBy("source").agg(F.min_by("text", "doc_id").alias("description"))
    return first.select(F.col("source").alias("category"), "description")


def _as_doubles(column: str):
    return F.col(column).cast("array<double>")


def news_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document has the embedding whose number is the document's, counted round; stored as floats, and doubles in all arithmetic."""
    n_vecs = n_rows(spark, sf_dir, "embeddings")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.pmod("doc_id", F.lit(n_vecs)).alias("vec_id"))
    vecs = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return lookup(docs, vecs, "vec_id", "inner").select(
        F.concat(F.lit("N"), F.col("doc_id").cast("string")).alias("news_id"), "vec"
    )


def user_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector of a user index is the embedding of that number; index 0 has the first one."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("user_idx"), _as_doubles("embedding").alias("vec")
    )


SEGMENTS = 3


def news_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(news_id, segment, vec)``: three embeddings per document, seven numbers apart; stored as floats, as ``news_vectors``."""
    n_vecs = n_rows(spark, sf_dir, "embeddings")
    segment = F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))).alias("segment")
    docs = table(spark, sf_dir, "documents").select("doc_id", segment)
    placed = docs.withColumn("vec_id", F.pmod(F.col("doc_id") + 7 * F.col("segment"), F.lit(n_vecs)))
    vecs = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return lookup(placed, vecs, "vec_id", "inner").select(
        F.concat(F.lit("N"), F.col("doc_id").cast("string")).alias("news_id"), "segment", "vec"
    )


def waves(rows: int, columns: int, seed: int) -> np.ndarray:
    """Closed-form weights ``sin(31 i + 17 j + seed) / sqrt(rows)`` with i, j from 1."""
    i, j = np.arange(1, rows + 1)[:, None], np.arange(1, columns + 1)[None, :]
    return np.sin(31 * i + 17 * j + seed) / np.sqrt(rows)
