"""Filter interaction audit: what every filter removes at every step of every order, by a recursive query.

A document is judged once: one bit per filter that it fails. Documents are counted per part and bit mask, which leaves
at most ``2 ** filters`` cells per part. A recursive query then extends filter prefixes with letters not yet used, joins
each with the mask cells of its part and carries the bits applied so far; each level of the recursion emits the metrics
of that step, once per prefix and not once per order. Orders take the rows of their prefixes.

``fail_masks`` judges texts in one pass without an exchange, ``repeated_texts`` adds the bit that needs the whole table:
digests are combined on the map side, the groups of two or more are written, and documents join them over two shuffled
sides, where a hot digest is split. ``audit`` works on any table of masks.

Defined cases: a null text is empty (no words: fails A, and D and C never; equal to any empty text), a null part is the
empty string, a document without a label is neither good nor toxic, and one with several is what any of them says. A
document without an id has no label and repeats nothing. Repeated rows are documents each; rows of the same id do not
repeat each other, as only a smaller id counts. An empty table gives no rows. Words are compared as 64-bit hashes, texts
as SHA-256 of the whole text. Columns beside those named are not read. Orders grow as the factorial of the filters.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickrank.llm import textbatch as tb
from clickrank.session import stage

#: Filters in the order of their bits.
FEW_WORDS, FEW_DISTINCT, CAPITALS, SYMBOLS, REPEATED = LETTERS = "ABCDE"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*|")] = True
_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def _bit(letter: str) -> int:
    return 1 << LETTERS.index(letter)


# ---------------------------------------------------------------- masks


def mask_column(column: pa.Array) -> np.ndarray:
    """Bits of the filters that a text alone decides."""
    out = np.zeros(len(column), np.int32)
    for first, end, data, offsets in tb.pieces(column):
        starts, ends, words = tb.word_spans(data, offsets)
        hashes = tb.word_hashes(data, starts, ends)
        n = np.diff(words)
        distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(words[:-1], words[1:])], np.int64)
        points = tb.row_sums((data & 0xC0) != 0x80, offsets)
        capitals = tb.row_sums((data >= 65) & (data <= 90), offsets)
        fails = {
            FEW_WORDS: n < 200,
            FEW_DISTINCT: 100 * distinct < 50 * n,
            CAPITALS: 100 * capitals > 3 * points,
            SYMBOLS: tb.row_sums(_SYMBOL[data], offsets) > 0,
        }
        out[first:end] = sum(np.where(failed, _bit(letter), 0) for letter, failed in fails.items())
    return out


def fail_masks(docs: DataFrame, part: str = "lang", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(_id, _part, _digest, _mask)`` of every document, written."""
    whole = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("_part"),
        F.unhex(F.sha2(whole, 256)).alias("_digest"), whole.alias("_text"),
    )
    schema = T.StructType([*narrow.drop("_text").schema.fields, T.StructField("_mask", T.IntegerType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [batch.column(c) for c in ("_id", "_part", "_digest")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(mask_column(batch.column("_text")))], names=schema.names)

    return stage(narrow.mapInArrow(judge, schema), "masks")


def repeated_texts(masks: DataFrame) -> DataFrame:
    """``masks`` with the bit of texts that a smaller id has too."""
    groups = masks.groupBy("_digest").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    shared = stage(groups.where("_rows > 1").drop("_rows"), "shared-texts")
    later = F.coalesce(F.col("_id") > F.col("_first"), F.lit(False))
    bits = F.when(later, F.col("_mask").bitwiseOR(F.lit(_bit(REPEATED)))).otherwise(F.col("_mask"))
    return masks.join(shared, "_digest", "left").select("_id", "_part", bits.alias("_mask"))


def label_flags(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(_id, _good, _toxic)``, one written row per labelled id."""
    flag = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    flags = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id"))
    return stage(flags.agg(flag("quality").alias("_good"), flag("toxic").alias("_toxic")), "flags")


# ---------------------------------------------------------------- the audit


def mask_cells(judged: DataFrame) -> DataFrame:
    """One written row per part with its cells ``(mask, n, good, toxic)``, at most one for each mask."""
    counted = judged.groupBy("_part", "_mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_good").cast("long").alias("good"), F.sum("_toxic").cast("long").alias("toxic")
    )
    cell = F.struct(F.col("_mask").alias("mask"), "n", "good", "toxic")
    return stage(counted.groupBy(F.col("_part").alias("part")).agg(F.collect_list(cell).alias("cells")), "cells")


def _total(field: str, condition: str) -> str:
    return f"aggregate(filter(c.cells, x -> {condition}), CAST(0 AS BIGINT), (total, x) -> total + x.{field})"


#: Metrics of a step from the mask cells, the bits applied before (``p.applied``) and the filter's own (``f.bit``).
_METRICS = {
    "kept": _total("n", "(x.mask & (p.applied | f.bit)) = 0"),
    "removed": _total("n", "(x.mask & p.applied) = 0 AND (x.mask & f.bit) <> 0"),
    "redundant": _total("n", "(x.mask & p.applied) <> 0 AND (x.mask & f.bit) <> 0"),
    "unique_fails": _total("n", "x.mask = f.bit"),
    "good_lost": _total("good", "(x.mask & p.applied) = 0 AND (x.mask & f.bit) <> 0"),
    "toxic_lost": _total("toxic", "(x.mask & p.applied) = 0 AND (x.mask & f.bit) <> 0"),
}


@contextmanager
def _unlimited_recursion(spark: SparkSession) -> Iterator[None]:
    """The rows of a recursive query grow with the parts; the depth is that of the letters."""
    before = spark.conf.get(_ROW_LIMIT, None)
    spark.conf.set(_ROW_LIMIT, "-1")
    try:
        yield
    finally:
        spark.conf.unset(_ROW_LIMIT) if before is None else spark.conf.set(_ROW_LIMIT, before)


def prefix_steps(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """``(part, prefix, letter, step, metrics...)`` of every prefix of every order, written."""
    filters = ", ".join(f"('{letter}', {1 << i})" for i, letter in enumerate(letters))
    query = f"""
        WITH RECURSIVE filters(letter, bit) AS (VALUES {filters}),
        steps(part, prefix, letter, applied, step, {", ".join(_METRICS)}) AS (
          SELECT part, '', '', 0, 0, {", ".join("CAST(0 AS BIGINT)" for _ in _METRICS)} FROM {{cells}}
          UNION ALL
          SELECT p.part, p.prefix || f.letter, f.letter, p.applied | f.bit, p.step + 1, {", ".join(_METRICS.values())}
          FROM steps p JOIN filters f ON (p.applied & f.bit) = 0 JOIN {{cells}} c ON c.part = p.part
        )
        SELECT part, prefix, letter, step, {", ".join(_METRICS)} FROM steps WHERE step > 0"""
    spark = cells.sparkSession
    with _unlimited_recursion(spark):
        return stage(spark.sql(query, cells=cells), "prefix-steps")


def audit(judged: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order and step from ``(_part, _mask, _good, _toxic)``."""
    steps = prefix_steps(mask_cells(judged), letters)
    orders = steps.where(F.col("step") == len(letters)).select(F.col("part").alias("_of"), F.col("prefix").alias("filter_order"))
    cut = F.transform(F.sequence(F.lit(1), F.lit(len(letters))), lambda i: F.substring("filter_order", F.lit(1), i))
    prefixes = orders.withColumn("_prefix", F.explode(cut))
    rows = prefixes.join(steps, (F.col("_of") == F.col("part")) & (F.col("_prefix") == F.col("prefix")))
    # At most one row for each order and filter of a part.
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter"))
    return rows.select("part", "filter_order", F.col("step").cast("int").alias("step"), *_METRICS, shapley.alias("shapley"))


def audit_documents(docs: DataFrame, labels: DataFrame, part: str = "lang", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The audit of the five filters over ``docs``."""
    masks = repeated_texts(fail_masks(docs, part, id_col, text))
    judged = masks.join(label_flags(labels, id_col), "_id", "left")
    flags = [F.coalesce(c, F.lit(0)).alias(c) for c in ("_good", "_toxic")]
    return audit(judged.select("_part", "_mask", *flags))
