"""Text and vectors for news ids.

``keys`` name a row where impression ids start anew in each split of a table. ``fits`` says whether the dimension can be
broadcast, for callers who know; without it the dimension is measured against ``broadcast_bytes``, which takes a job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickrank.functions.arrays import fit_history
from clickrank.operators.scale import fits_broadcast, lookup
from clickrank.schema import EMPTY_NEWS_ID

IMPRESSION = ("impression_id",)


def with_empty_news(news: DataFrame) -> DataFrame:
    """Adds the sentinel news with empty text in every other string column."""
    empty = news.sparkSession.range(1).select(
        *[F.lit(EMPTY_NEWS_ID if c == "news_id" else "").alias(c) for c in news.columns]
    )
    return news.unionByName(empty)


def missing_keys(fact: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Fact rows per key that the dimension does not know. Counted before the join, so a hot key is one row."""
    counts = fact.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.join(dim.select(key).distinct(), key, "left_anti")


def require_keys(fact: DataFrame, dim: DataFrame, key: str) -> None:
    """J8, strict: raises when a key is unknown, naming up to five."""
    unknown = [row[key] for row in missing_keys(fact, dim, key).orderBy(F.desc("n_rows"), key).take(5)]
    if unknown:
        raise KeyError(f"{key} not found: {unknown}")


def with_text(
    rows: DataFrame, news_text: DataFrame, strict: bool, fits: bool | None = None, broadcast_bytes: int | None = None
) -> DataFrame:
    """Text columns for every row's news id; unknown news have empty ones unless ``strict``."""
    texts = [c for c in news_text.columns if c != "news_id"]
    known = with_empty_news(news_text)
    if strict:
        require_keys(rows, known, "news_id")
    joined = lookup(rows, known, "news_id", fits=fits, broadcast_bytes=broadcast_bytes)
    return joined.select(*rows.columns, *[F.coalesce(c, F.lit("")).alias(c) for c in texts])


def by_impression(
    rows: DataFrame, news_text: DataFrame, keys: Sequence[str] = IMPRESSION, fits: bool | None = None, broadcast_bytes: int | None = None
) -> tuple[DataFrame, bool]:
    """Rows placed by impression while they are still packed ids, if the text can be broadcast to them.

    The items unrolled from such a row stay where they are, so packing them again with their text needs no
    exchange of the text. Otherwise the text join moves the items anyway and the rows are left alone.
    """
    fits = fits_broadcast(news_text, broadcast_bytes) if fits is None else fits
    return (rows.repartition(*keys) if fits else rows), fits


def candidate_titles(
    candidates: DataFrame, news: DataFrame, strict: bool = False, fits: bool | None = None, broadcast_bytes: int | None = None
) -> DataFrame:
    """The title of every candidate; unknown news have an empty one unless ``strict``."""
    return with_text(candidates, news.select("news_id", "title"), strict, fits, broadcast_bytes)


def candidate_texts(
    candidates: DataFrame, news_text: DataFrame, strict: bool = False, fits: bool | None = None, broadcast_bytes: int | None = None
) -> DataFrame:
    """Title and category description of every candidate."""
    return with_text(candidates, news_text.select("news_id", "title", "category_description"), strict, fits, broadcast_bytes)


def history_slots(
    behaviors: DataFrame, history_size: int, keep: tuple[str, ...] = (), keys: Sequence[str] = IMPRESSION
) -> DataFrame:
    """One row per padded history slot, in order."""
    fitted = fit_history(F.col("history"), history_size)
    return behaviors.select(*keys, *keep, F.posexplode(fitted).alias("slot", "news_id"))


def _history(
    behaviors: DataFrame, text: DataFrame, history_size: int, strict: bool, keys: Sequence[str],
    fits: bool | None = None, broadcast_bytes: int | None = None,
) -> DataFrame:
    texts = [c for c in text.columns if c != "news_id"]
    placed, fits = by_impression(behaviors.select(*keys, "history"), text, keys, fits, broadcast_bytes)
    rows = with_text(history_slots(placed, history_size, keys=keys), text, strict, fits)
    # At most history_size rows per impression.
    return rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("slot", "news_id", *texts))).alias("history")
    )


def history_titles(
    behaviors: DataFrame, news: DataFrame, history_size: int, strict: bool = False, keys: Sequence[str] = IMPRESSION,
    fits: bool | None = None, broadcast_bytes: int | None = None,
) -> DataFrame:
    """Per impression the ``(slot, news_id, title)`` of the padded history, order kept."""
    return _history(behaviors, news.select("news_id", "title"), history_size, strict, keys, fits, broadcast_bytes)


def history_texts(
    behaviors: DataFrame, news_text: DataFrame, history_size: int, strict: bool = False, keys: Sequence[str] = IMPRESSION,
    fits: bool | None = None, broadcast_bytes: int | None = None,
) -> DataFrame:
    """As ``history_titles`` with the category description."""
    return _history(behaviors, news_text.select("news_id", "title", "category_description"), history_size, strict, keys, fits, broadcast_bytes)


def attach_description(
    news: DataFrame, descriptions: DataFrame, strict: bool = False, fits: bool | None = None, broadcast_bytes: int | None = None
) -> DataFrame:
    """``(news_id, title, category_description)``; the description is looked up by subcategory."""
    by_subcategory = descriptions.select(
        F.col("category").alias("subcategory"), F.col("description").alias("category_description")
    )
    if strict:
        require_keys(news, by_subcategory, "subcategory")
    joined = lookup(news.select("news_id", "subcategory", "title"), by_subcategory, "subcategory", fits=fits, broadcast_bytes=broadcast_bytes)
    return joined.select(
        "news_id", "title", F.coalesce("category_description", F.lit("")).alias("category_description")
    )


def attach_user_vector(
    rows: DataFrame, user_vectors: DataFrame, fits: bool | None = None, broadcast_bytes: int | None = None
) -> DataFrame:
    """The vector of the row's user index as ``user_vec``; repeated for each of the user's rows."""
    vectors = user_vectors.select("user_idx", F.col("vec").alias("user_vec"))
    return lookup(rows, vectors, "user_idx", fits=fits, broadcast_bytes=broadcast_bytes)
