"""Line dedup with built-in functions only: range-partitioned hashes, first occurrences, keep bitmaps per document.

Every line of at least ``min_chars`` code points (stripped of ASCII white space, A-Z folded) is an occurrence (hash,
document, position). Texts are split once. Occurrences are range-partitioned by hash, then document from the largest id
down, then position, and written in that order; a hash that fills many parts is spread over them. Within a part the first
occurrence of a hash, in the written order, is of the document that keeps its lines, and every change of the document
counts one. Only the first and the last hash of a part can reach into another part: their few rows, one for each hash and
part, are combined in the order of the parts. So no task holds a hash, and no line but those of the borders is joined.
What a document loses is returned as a bitmap in sparse 64-bit words, without text: a document that keeps all has no
row, a run of 64 kept lines no word. Texts of documents that lose nothing are not moved while the others are few enough
to be named by a broadcast.

Defined cases: a null or empty text is one empty line; a null id is a document smaller than all others; rows that repeat
an id are one document when documents are counted, and each row loses its own lines; equal lines of the keeping
document all stay; an empty table gives no bitmaps; other columns are ignored or, in ``drop_lines``, kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickrank.llm.tables import BROADCAST_IDS, join_ids
from clickrank.session import stage

MIN_CHARS = 40
MIN_DOCS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\f\r")), UPPER, LOWER)


def occurrences(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(line, doc_id, text_hash, pos) of the lines that are long enough, written in range and sort order, with the number
    of the part and the place in it."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"),
        F.posexplode(F.transform(lines_of(F.col(text)), line_key)).alias("pos", "key"),
    ).where(F.char_length("key") >= min_chars)
    # Written first, so that the range bounds are sampled without splitting the texts again.
    rows = stage(rows.select(F.unhex(F.md5("key")).alias("line"), "doc_id", "text_hash", "pos"), "hashes")
    by = [F.col("line"), F.col("doc_id").desc_nulls_last(), F.col("pos")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    return stage(ordered.withColumn("row", F.monotonically_increasing_id()), "lines").withColumn("part", F.shiftright("row", 33))


def _border_lines(counted: DataFrame, placed: DataFrame) -> DataFrame:
    """(line, keeper, docs) over all parts of the lines that begin or end a part, at most two rows for each part."""
    borders = placed.groupBy("part").agg(F.min("line").alias("low"), F.max("line").alias("high"))
    borders = borders.select("part", F.explode(F.array_distinct(F.array("low", "high"))).alias("line"))
    per_part = counted.join(F.broadcast(borders), ["part", "line"]).groupBy("line", "part").agg(
        F.max("docs").alias("docs"), F.min_by("doc_id", "row").alias("first"), F.max_by("doc_id", "row").alias("last")
    )
    before = Window.partitionBy("line").orderBy("part")
    # A document that ends one part and begins the next was counted in both.
    again = (F.lag("part").over(before).isNotNull() & F.lag("last").over(before).eqNullSafe(F.col("first"))).cast("int")
    summed = per_part.withColumn("again", again).groupBy("line")
    return stage(summed.agg(F.min_by("first", "part").alias("keeper"), (F.sum("docs") - F.sum("again")).alias("docs")), "border-lines")


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, **columns) -> DataFrame:
    """Per row that loses lines: doc_id, text_hash, n_dropped and the bitmap ``words`` of (word, bits) in order."""
    placed = occurrences(docs, min_chars, **columns)
    run = Window.partitionBy("part", "line")
    ordered = run.orderBy("row")
    new = F.lag("row").over(ordered).isNull() | ~F.lag("doc_id").over(ordered).eqNullSafe(F.col("doc_id"))
    streamed = placed.withColumn("new", new.cast("int")).withColumn("keeper", F.first("doc_id").over(ordered))
    counted = stage(streamed.withColumn("docs", F.sum("new").over(run)).drop("new"), "counted-lines")
    borders = _border_lines(counted, placed).select("line", F.col("keeper").alias("whole_keeper"), F.col("docs").alias("whole_docs"))
    whole = counted.join(F.broadcast(borders), "line", "left")
    known = F.col("whole_docs").isNotNull()
    keeper, n_docs = F.when(known, F.col("whole_keeper")).otherwise(F.col("keeper")), F.coalesce("whole_docs", "docs")
    below = F.coalesce(F.col("doc_id") < keeper, keeper.isNotNull() & F.col("doc_id").isNull())
    gone = whole.where((n_docs >= min_docs) & below)
    bit = F.expr("shiftleft(1L, pos % 64)")
    words = gone.groupBy("doc_id", "text_hash", F.expr("pos div 64").cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("doc_id", "text_hash").agg(
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"), F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words")
    )


def without_lines(lines: Column, words: Column) -> Column:
    """The lines whose bit is not set."""
    known = F.map_from_entries(words)
    last = F.expr("0").cast("int") + F.floor((F.size(lines) - 1) / 64).cast("int")
    dense = F.transform(F.sequence(F.lit(0), last), lambda w: F.coalesce(F.try_element_at(known, w), F.lit(0).cast("long")))
    return F.filter(lines, lambda x, i: F.getbit(F.element_at(dense, F.floor(i / 64).cast("int") + 1), i % 64) == 0)


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", limit: int = BROADCAST_IDS, **how) -> DataFrame:
    """``docs`` with the struct ``_lines`` of n_lines, n_dropped and the kept text, from the bitmaps."""
    gone = stage(dropped_lines(docs, id_col=id_col, text=text, **how), "bitmaps")
    ids = stage(gone.select("doc_id").where("doc_id IS NOT NULL").distinct(), "losing")
    gone = gone.select(*[F.col(c).alias(f"_gone_{c}") for c in gone.columns])

    def joined(docs: DataFrame) -> DataFrame:
        match = docs[id_col].cast("long").eqNullSafe(gone["_gone_doc_id"]) & (F.xxhash64(docs[text]) == gone["_gone_text_hash"])
        return _with_lines(docs, docs.join(gone, match, "left"), text, F.col("_gone_words"), F.col("_gone_n_dropped"))

    if ids.count() > limit:
        return joined(docs)
    named = docs.where(F.col(id_col).isNotNull())
    none = F.lit(None).cast(gone.schema["_gone_words"].dataType)
    kept = join_ids(named, ids, "left_anti", id_col, limit)
    return (
        joined(join_ids(named, ids, "left_semi", id_col, limit))
        .unionByName(_with_lines(kept, kept, text, none, F.lit(None).cast("long")))
        .unionByName(joined(docs.where(F.col(id_col).isNull())))
    )


def _with_lines(docs: DataFrame, rows: DataFrame, text: str, words: Column, n_dropped: Column) -> DataFrame:
    whole = F.coalesce(docs[text], F.lit(""))
    kept = F.when(words.isNull(), whole).otherwise(F.array_join(without_lines(lines_of(docs[text]), words), "\n"))
    n_lines = (F.char_length(whole) - F.char_length(F.translate(whole, "\n", "")) + 1).cast("long")
    found = F.struct(n_lines.alias("n_lines"), F.coalesce(n_dropped, F.lit(0).cast("long")).alias("n_dropped"), kept.alias("text"))
    return rows.select(*[docs[f"`{c}`"] for c in docs.columns], found.alias("_lines"))
