"""Reproducible training samples, training and evaluation rows, mini-batches.

A behaviour row already holds all candidates of its impression, so drawing and shuffling are column
expressions over that row: no exchange, no window, whatever the number of impressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickrank.functions.arrays import append_empty_candidate, fit_history, label_vector, target_index
from clickrank.functions.keys import seeded_key
from clickrank.operators.lookup import IMPRESSION, by_impression, with_text
from clickrank.operators.scale import dense_index
from clickrank.operators.users import attach_user_idx
from clickrank.schema import EMPTY_NEWS_ID, FILLER_POS



def _drawn(label: int, n: int, seed: int, epoch: int, keys: Sequence[str]) -> Column:
    """The ``n`` items of this label with the smallest keys."""
    keyed = F.transform(
        "impressions",
        lambda x, i: F.when(
            x["clicked"] == label,
            F.struct(
                seeded_key(seed, epoch, *keys, i).alias("key"), i.alias("pos"), x["news_id"].alias("news_id"),
                x["clicked"].alias("clicked"),
            ),
        ),
    )
    return F.slice(F.array_sort(F.filter(keyed, lambda x: x.isNotNull())), 1, n)


def sample_positive(behaviors: DataFrame, seed: int, epoch: int = 0, keys: Sequence[str] = IMPRESSION) -> DataFrame:
    """``positive``, one clicked item drawn uniformly, as an array that is empty without a click."""
    return behaviors.select("*", _drawn(1, 1, seed, epoch, keys).alias("positive"))


def sample_negatives(
    behaviors: DataFrame, npratio: int, seed: int, epoch: int = 0, keys: Sequence[str] = IMPRESSION
) -> DataFrame:
    """``negatives``, ``npratio`` unclicked items without replacement. If there are fewer, all of them and
    the empty news (position -1) as often as needed."""
    drawn = behaviors.select("*", _drawn(0, npratio, seed, epoch, keys).alias("_drawn"))
    filler = F.struct(
        F.lit("").alias("key"), F.lit(FILLER_POS).alias("pos"), F.lit(EMPTY_NEWS_ID).alias("news_id"),
        F.lit(0).alias("clicked"),
    )
    missing = F.lit(npratio) - F.size("_drawn")
    return drawn.select(*behaviors.columns, F.concat("_drawn", F.array_repeat(filler, missing)).alias("negatives"))


def shuffle_sample(sampled: DataFrame, seed: int, epoch: int = 0, keys: Sequence[str] = IMPRESSION) -> DataFrame:
    """``sample``, the drawn items in random order. ``pick`` numbers them as drawn, the positive being 0."""
    mixed = F.transform(
        F.concat("positive", "negatives"),
        lambda x, i: F.struct(
            seeded_key(seed, epoch, F.lit("slot"), *keys, i).alias("key"), i.alias("pick"), x["pos"].alias("pos"),
            x["news_id"].alias("news_id"), x["clicked"].alias("clicked"),
        ),
    )
    others = [c for c in sampled.columns if c not in ("positive", "negatives")]
    return sampled.select(*others, F.array_sort(mixed).alias("sample"))


def draw_sample(
    behaviors: DataFrame, npratio: int, seed: int, epoch: int = 0, keys: Sequence[str] = IMPRESSION
) -> DataFrame:
    """X1-X3 together with ``target``; impressions without a click are left out (``click_stats`` counts them)."""
    positive = sample_positive(behaviors.where(F.exists("impressions", lambda x: x["clicked"] == 1)), seed, epoch, keys)
    shuffled = shuffle_sample(sample_negatives(positive, npratio, seed, epoch, keys), seed, epoch, keys)
    return shuffled.select("*", target_index(F.transform("sample", lambda x: x["clicked"])).alias("target"))


def _attach_texts(
    rows: DataFrame, news_text: DataFrame, strict: bool, keys: Sequence[str], fits: bool | None = None, broadcast_bytes: int | None = None
) -> DataFrame:
    """Replaces ids by ``(news_id, text...)``: one join for candidates and history together."""
    carried = [c for c in rows.columns if c not in ("candidates", "history")]
    texts = [c for c in news_text.columns if c != "news_id"]

    def tagged(array: str, part: int, news_id, clicked) -> Column:
        return F.transform(
            array,
            lambda x, i: F.struct(
                F.lit(part).alias("part"), i.alias("slot"), news_id(x).alias("news_id"), clicked(x).alias("clicked")
            ),
        )

    items = F.concat(
        tagged("candidates", 0, lambda x: x["news_id"], lambda x: x["clicked"]),
        tagged("history", 1, lambda x: x, lambda x: F.lit(None).cast("int")),
    )
    placed, fits = by_impression(rows, news_text, keys, fits, broadcast_bytes)
    flat = with_text(placed.select(*carried, F.inline(items)), news_text, strict, fits)
    item = F.struct("part", "slot", "news_id", "clicked", *texts)
    # A group is the content of one behaviour row: its candidates and at most history_size slots.
    packed = flat.groupBy(*carried).agg(F.array_sort(F.collect_list(item)).alias("_items"))

    def part(n: int, *fields: str) -> Column:
        chosen = F.filter("_items", lambda x: x["part"] == n)
        return F.transform(chosen, lambda x: F.struct(*[x[f].alias(f) for f in fields]))

    return packed.select(
        *carried,
        part(0, "news_id", "clicked", *texts).alias("candidates"),
        part(1, "news_id", *texts).alias("history"),
    )


def training_examples(
    behaviors: DataFrame,
    news_text: DataFrame | None,
    user_index: DataFrame,
    npratio: int,
    history_size: int,
    seed: int,
    epoch: int = 0,
    strict: bool = False,
    keys: Sequence[str] = IMPRESSION,
    fits: bool | None = None,
    broadcast_bytes: int | None = None,
) -> DataFrame:
    """One row per impression with a click: shuffled candidates, padded history, user index, target.

    Without ``news_text`` the rows keep ids only, which needs no exchange at all.
    """
    sampled = draw_sample(attach_user_idx(behaviors, user_index), npratio, seed, epoch, keys)
    candidates = F.transform(
        "sample", lambda x: F.struct(x["news_id"].alias("news_id"), x["clicked"].alias("clicked"))
    )
    rows = sampled.select(
        *keys, "user_idx", "target", candidates.alias("candidates"),
        fit_history(F.col("history"), history_size).alias("history"),
    )
    return rows if news_text is None else _attach_texts(rows, news_text, strict, keys, fits, broadcast_bytes)


def evaluation_examples(
    behaviors: DataFrame,
    news_text: DataFrame | None,
    user_index: DataFrame,
    history_size: int,
    include_empty: bool = True,
    strict: bool = False,
    keys: Sequence[str] = IMPRESSION,
    fits: bool | None = None,
    broadcast_bytes: int | None = None,
) -> DataFrame:
    """One row per impression with every candidate, the empty one at the end, and the label vector."""
    shown = append_empty_candidate(F.col("impressions")) if include_empty else F.col("impressions")
    rows = attach_user_idx(behaviors, user_index).select(
        *keys, "user_idx", shown.alias("candidates"), fit_history(F.col("history"), history_size).alias("history")
    )
    if news_text is not None:
        rows = _attach_texts(rows, news_text, strict, keys, fits, broadcast_bytes)
    return rows.select("*", label_vector(F.col("candidates")).alias("labels"))


def assign_batches(
    examples: DataFrame, batch_size: int, seed: int, epoch: int = 0, keys: Sequence[str] = IMPRESSION
) -> DataFrame:
    """``batch`` and ``place`` of each row under a random order of the whole table; only the last batch
    may be short. The order is that of hashes, numbered by range parts."""
    keyed = examples.withColumn("_key", seeded_key(seed, epoch, F.lit("batch"), *keys))
    placed = dense_index(keyed, [F.col("_key"), *[F.col(k) for k in keys]], "_place", 0)
    return placed.select(
        *examples.columns,
        F.floor(F.col("_place") / batch_size).alias("batch"),
        F.pmod("_place", F.lit(batch_size)).alias("place"),
    )
