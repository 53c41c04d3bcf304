"""Mixing sources to target weights: hash-random order in each source, distributed prefix sums, exact cuts, epochs.

Sources in code point order, null last, weigh ``weights`` in turn. The budget (by default all words) is shared by
weight; a source takes at most ``epochs`` times its size, and what it cannot take is shared among the others by weight
again. A source of target t and size s is taken whole floor(t / s) times and once more up to the remainder, in the
order of a hash of seed, id and text; the document at the cut is taken in part, so that every source's sum is the
floor of its target.

Defined cases: null and empty texts have size 0 and are never taken; a null source is a source of its own, the last; a
null id is left out of the hash; repeated rows tie and are taken one after the other, each within its own size; an empty
table gives an empty result; other columns are ignored by ``mix`` and kept by ``mixed_documents``. No task holds a
source, however large. The table of sources is small (one row a source) and meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickrank.llm.tables import prefix_sums
from clickrank.session import stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
EPOCHS = 3


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    The level x with sum(min(epochs * size, x * weight)) = budget is found in closed form: sources are filled up in the
    order of epochs * size / weight, and the first whose share fits sets the level for the rest.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = totals.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    ).withColumn("most", (epochs * F.col("source_size")).cast("double"))
    filling = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    budget = F.sum("source_size").over(Window.partitionBy()).cast("double")
    level = (budget - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    levels = weighed.withColumn("level", level).withColumn("fits", F.col("most") / F.col("weight") >= F.col("level"))
    first = F.min(F.when(F.col("fits"), F.struct(F.col("most") / F.col("weight"), F.col("level").alias("level")))).over(
        Window.partitionBy()
    )
    share = F.coalesce(first["level"] * F.col("weight"), F.col("most"))
    return levels.select("source", "source_size", F.least("most", share).alias("target"))


def _draw(seed: int, doc_id: Column, text_hash: Column) -> Column:
    """MD5, so that any engine finds the same order; a null id or text is left out of what is hashed."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string"), text_hash))


def _word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _drawn(docs: DataFrame, weights: Sequence[float], epochs: int, seed: int, id_col: str, text: str, source: str) -> DataFrame:
    """doc_id, source, size, text_hash, draw, source_size, target, whole (epochs), ``rest`` (words of the last, partial
    epoch) and ``before`` (words of the source drawn before the row)."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source).alias("source"), _word_count(F.col(text)).alias("size"),
        F.md5(F.col(text)).alias("text_hash"),
    ).withColumn("draw", _draw(seed, F.col("doc_id"), F.col("text_hash")))
    rows = stage(rows, "sizes")
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    targets = source_targets(rows, weights, epochs).withColumn("whole", whole)
    targets = targets.withColumn("rest", budget - F.col("whole") * F.col("source_size"))
    targets = stage(targets.withColumnRenamed("source", "_source"), "targets")
    placed = prefix_sums(rows, ["source"], [F.col("draw"), F.col("doc_id"), F.col("text_hash")], "size", "before")
    return placed.join(targets, placed["source"].eqNullSafe(targets["_source"])).drop("_source")


TAKEN = "whole * size + greatest(0, least(size, rest - before))"


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    epochs: int = EPOCHS,
    seed: int = 42,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """Per row: doc_id, text_hash, source, size, source_size, target, taken (words, repeats counted)."""
    drawn = _drawn(docs, weights, epochs, seed, id_col, text, source)
    return drawn.select("doc_id", "text_hash", "source", "size", "source_size", "target", F.expr(TAKEN).cast("long").alias("taken"))


def mixed_documents(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: int = EPOCHS, seed: int = 42, source: str = "source"
) -> DataFrame:
    """The mix itself: each document once for every time it is taken whole, and cut after the words taken of it.

    A row's draw can be computed where the text lies, so only one row per source is joined to the texts: the place of
    the cut. Rows before it are taken once more, rows after it are not. Rows that repeat the id and text at a cut are
    taken as one of them, as often as all together. A document that is not taken is not returned.
    """
    names = docs.columns
    drawn = _drawn(docs, weights, epochs, seed, "doc_id", "text", source)
    place = F.struct("draw", "doc_id", "text_hash")
    beyond = F.min(F.when((F.col("size") > 0) & (F.col("before") + F.col("size") > F.col("rest")), place))
    cuts = stage(drawn.groupBy(F.col("source").alias("_source")).agg(beyond.alias("_cut"), F.first("whole").alias("_whole")), "cuts")
    mine = F.md5(docs["text"])
    here = docs.withColumns({"_hash": mine, "_size": _word_count(docs["text"])})
    here = here.withColumn("_place", F.struct(
        _draw(seed, docs["doc_id"].cast("long"), F.col("_hash")).alias("draw"), docs["doc_id"].cast("long").alias("doc_id"),
        F.col("_hash").alias("text_hash"),
    )).where("_size > 0")
    near = here.join(cuts, here[source].eqNullSafe(cuts["_source"]))
    clear = near.where(F.col("_cut").isNull() | ~F.col("_place").eqNullSafe(F.col("_cut")))
    times = F.col("_whole") + F.when(F.col("_cut").isNull() | (F.col("_place") < F.col("_cut")), 1).otherwise(0)
    whole = clear.withColumn("_times", F.explode(F.array_repeat(F.lit(1), times.cast("int"))))

    at = drawn.join(cuts.where("_cut IS NOT NULL"), drawn["source"].eqNullSafe(cuts["_source"])).where(place.eqNullSafe(F.col("_cut")))
    sums = stage(at.groupBy("_source").agg(F.sum(F.expr(TAKEN)).cast("long").alias("_taken"), F.count(F.lit(1)).alias("_rows")), "at-cuts")
    rows = near.where(F.col("_place").eqNullSafe(F.col("_cut"))).drop("_source")
    if not sums.where("_rows > 1").isEmpty():
        rows = rows.dropDuplicates(["_place"])
    rows = rows.join(sums, rows[source].eqNullSafe(sums["_source"]))
    copies = F.floor(F.col("_taken") / F.col("_size"))
    rest = F.col("_taken") - copies * F.col("_size")
    parts = F.concat(F.array_repeat(F.col("_size"), copies.cast("int")), F.filter(F.array(rest), lambda x: x > 0))
    cut = rows.withColumn("_words", F.explode(parts))
    text = F.when(F.col("_words") == F.col("_size"), F.col("text")).otherwise(_cut(F.col("text"), F.col("_words")))
    cut = cut.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in names])
    return whole.select(*[F.col(f"`{c}`") for c in names]).unionByName(cut)


def _cut(text, n):
    """The first ``n`` words, joined as they were: split once, no nested repetition."""
    words = F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+", ""), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(words, F.lit(1), n.cast("int")), "")
