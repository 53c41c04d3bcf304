"""Column expressions over packed candidate lists and click histories. One row is one impression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clickrank.schema import EMPTY_NEWS_ID

CANDIDATES = "array<struct<news_id:string,clicked:int>>"


def parse_impressions(packed: Column) -> Column:
    """``"N1-0 N2-1"`` to ``[{news_id, clicked}]``; an item without a label gets a NULL label."""

    def item(text: Column) -> Column:
        fields = F.split(text, "-")
        return F.struct(
            F.get(fields, F.lit(0)).alias("news_id"), F.get(fields, F.lit(1)).cast("int").alias("clicked")
        )

    return F.transform(F.split(packed, " "), item)


def parse_history(packed: Column) -> Column:
    """``"N1 N2"`` to an array; an absent history stays NULL."""
    return F.split(F.nullif(packed, F.lit("")), " ")


def history_or_empty(history: Column) -> Column:
    """P3 at use: NULL becomes an empty list."""
    return F.coalesce(history, F.array().cast("array<string>"))


def positions(impressions: Column, label: int) -> Column:
    """P5: zero-based positions of the items with this label."""
    at = F.transform(impressions, lambda x, i: F.when(x["clicked"] == label, i))
    return F.filter(at, lambda i: i.isNotNull())


def append_empty_candidate(impressions: Column) -> Column:
    """The sentinel news item as one more unclicked candidate."""
    empty = F.struct(F.lit(EMPTY_NEWS_ID).alias("news_id"), F.lit(0).alias("clicked"))
    return F.concat(impressions, F.array(empty).cast(CANDIDATES))


def fit_history(history: Column, history_size: int) -> Column:
    """The first ``history_size`` ids, padded at the end with the sentinel."""
    kept = F.slice(history_or_empty(history), 1, history_size)
    return F.concat(kept, F.array_repeat(F.lit(EMPTY_NEWS_ID), F.lit(history_size) - F.size(kept)))


def label_vector(impressions: Column) -> Column:
    """The labels of all candidates in order."""
    return F.transform(impressions, lambda x: x["clicked"])


def target_index(labels: Column) -> Column:
    """P10: position of the first clicked item, from 0."""
    return (F.array_position(labels, 1) - 1).cast("int")


def all_elements(values: Column, predicate) -> Column:
    """P11, array form."""
    return F.forall(values, predicate)


def uniq_elements(values: Column) -> Column:
    """P12, array form."""
    return F.array_distinct(values)
