"""Substring dedup: compressed FM-indexes per shard, backward search, matching statistics, intervals above a threshold.

A window is ``window`` consecutive words of one document. It is removed where its word sequence also starts in a
document of smaller id; a document loses the words that its removed windows cover.

1. Documents of equal word sequences are one: all but the smallest id lose everything (if they have a window at all).
2. In every window one word ``anchor``-gram is chosen, the one of least hash, so that equal windows choose equal anchors.
   Only anchors of two or more documents can be in a repeated window.
3. Runs of windows with the same shared anchor are segments. Equal segments are one content, with the least id of its
   documents (combined on the map side). Contents go to the shard of their anchor; where an anchor is very frequent,
   each window is a content of its own in the shard of its hash, so that no anchor fills a shard.
4. Each shard builds an FM-index of the contents with the smaller ids and streams all contents through it. Where the
   matching statistic of a window reaches the threshold, the interval of suffixes gives the least id of all documents that
   hold it. Windows that fail the threshold are streamed through an index of the other contents.
5. Segments of documents with a larger id than that report their windows, and texts lose what these cover.

Word sequences are compared as 64-bit word hashes. Texts are moved only for documents with shared anchors or removed
windows, as long as those are few enough to be named by a broadcast, and else by a plain join.

Defined cases: null and empty texts have no words; a null id loses nothing and is no smaller than any; rows that repeat
an id are one document, so that nothing is removed between them, and each keeps its own words; an empty table gives an
empty result; other columns are ignored. A long text is handled in one task, in memory of a multiple of its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickrank.llm import textbatch as tb
from clickrank.llm.fm_index import DEPTH, FMIndex
from clickrank.llm.tables import BROADCAST_IDS, join_ids
from clickrank.session import stage

WINDOW = 13
ANCHOR = 4
FREQUENT = 2_000       # occurrences above which an anchor's windows are dealt one by one
SHARD_WORDS = 150_000  # words aimed at in a shard


def _word_rows(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Word hashes of each row."""
    for first, end, data, offsets in tb.pieces(batch.column("text")):
        starts, ends, words = tb.word_spans(data, offsets)
        hashes = tb.word_hashes(data, starts, ends)
        for i in range(end - first):
            yield hashes[words[i] : words[i + 1]]


def window_anchors(words: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor hash, anchor place) of every window; the leftmost of equal ones is chosen."""
    grams = tb.gram_hashes(words, anchor)
    n, span = len(words) - window + 1, window - anchor + 1
    best, place = grams[:n].copy(), np.arange(n)
    for shift in range(1, span):
        other = grams[shift : shift + n]
        less = other < best
        best[less] = other[less]
        place[less] = np.flatnonzero(less) + shift
    return best, place


def _sequences(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_words and digest of the word sequence."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests = [], []
            for words in _word_rows(batch):
                n.append(len(words))
                digests.append(hashlib.md5(words.tobytes()).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(digests, pa.binary())],
                ["doc_id", "text_hash", "n_words", "digest"],
            )

    return docs.mapInArrow(work, "doc_id long, text_hash long, n_words long, digest binary")


def _anchors(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                np.unique(window_anchors(words, window, anchor)[0]) if len(words) >= window else np.zeros(0, np.uint64)
                for words in _word_rows(batch)
            ]
            offsets = np.zeros(len(found) + 1, np.int32)
            np.cumsum([len(x) for x in found], out=offsets[1:])
            flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "anchors"])

    return docs.mapInArrow(work, "doc_id long, anchors array<long>")


def _segments(docs: DataFrame, shards: int, window: int, anchor: int) -> DataFrame:
    """Rows of (shard, content, words, doc_id, text_hash, start) from documents with their shared and frequent anchors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, shard, keys, contents = [], [], [], [], []
            shared, frequent = batch.column("shared"), batch.column("frequent")
            for i, words in enumerate(_word_rows(batch)):
                if len(words) < window:
                    continue
                best, place = window_anchors(words, window, anchor)
                known = np.isin(best, shared[i].values.to_numpy().view(np.uint64))
                single = known & np.isin(best, frequent[i].values.to_numpy().view(np.uint64))
                change = np.ones(len(best), bool)
                change[1:] = (place[1:] != place[:-1]) | single[1:]
                first = np.flatnonzero(change)
                last = np.append(first[1:], len(best))
                hashes = tb.gram_hashes(words, window)
                for a, b in zip(first[known[first]].tolist(), last[known[first]].tolist()):
                    raw = words[a : b + window - 1].tobytes()
                    rows.append(i)
                    starts.append(a)
                    shard.append(int(hashes[a] if single[a] else best[a]) % shards)
                    keys.append(hashlib.md5(raw).digest())
                    contents.append(raw)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard, pa.int32()), pa.array(keys, pa.binary()), pa.array(contents, pa.binary()),
                 batch.column("doc_id").take(at), batch.column("text_hash").take(at), pa.array(starts, pa.int32())],
                ["shard", "content", "words", "doc_id", "text_hash", "start"],
            )

    return docs.mapInArrow(work, "shard int, content binary, words binary, doc_id long, text_hash long, start int")


def _streamed(index: FMIndex, contents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(the symbols that ``index`` has for the contents, with an unknown one before each, and where each begins)."""
    lengths = np.array([len(c) + 1 for c in contents], np.int64)
    starts = np.cumsum(lengths) - lengths + 1
    symbols = np.full(int(lengths.sum()), -1, np.int64)
    inside = np.ones(len(symbols), bool)
    inside[starts - 1] = False
    symbols[inside] = index.encode(np.concatenate(contents))
    return symbols, starts


def _windows_of(starts: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Ends (exclusive) of all windows of contents that begin at ``starts``."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum())) + window


def earliest(contents: list[np.ndarray], holders: np.ndarray, window: int) -> list[np.ndarray]:
    """For every window of every content, the least holder of a content that has the same window.

    The half of smaller holders is indexed, and all contents are streamed through it. Where the matching statistic of a
    window reaches the threshold, which is the window, its interval of suffixes gives the least holder. Windows that fail
    it are in no content of that half; they are streamed through an index of the other half.
    """
    order = np.argsort(holders, kind="stable")
    counts = np.array([len(c) - window + 1 for c in contents], np.int64)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    least = np.full(bounds[-1], -1, np.int64)
    waiting = np.ones(len(least), bool)
    half = max(1, len(order) // 2)
    for indexed, asking in ((order[:half], order), (order[half:], order[half:])):
        if not len(indexed) or not len(asking):
            continue
        index = FMIndex(np.concatenate([contents[i] for i in indexed]), np.array([len(contents[i]) for i in indexed], np.int64))
        symbols, starts = _streamed(index, [contents[i] for i in asking])
        ends = _windows_of(starts, counts[asking], window)
        into = _windows_of(bounds[asking], counts[asking], 0)  # place of each window in ``least``
        ends, into = ends[waiting[into]], into[waiting[into]]
        reached, low, high = index.matching(symbols, ends, window)
        found = reached >= window
        by_place = np.repeat(holders[indexed], [len(contents[i]) + 1 for i in indexed])
        least[into[found]] = index.minima(by_place, low[found], high[found])
        waiting[into[found]] = False
    return np.split(least, bounds[1:-1])


def _search(contents: DataFrame, window: int) -> DataFrame:
    """(content, least): for each window of a content the least id of all documents that hold it."""

    def work(table: pa.Table) -> pa.Table:
        words = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("words")]
        least = earliest(words, table.column("holder").to_numpy(), window)
        return pa.table({"content": table.column("content"), "least": pa.array(least, pa.list_(pa.int64()))})

    return contents.groupBy("shard").applyInArrow(work, "content binary, least array<long>")


def _with_side(docs: DataFrame, side: DataFrame, keys: list[str], inner: bool) -> DataFrame:
    """``docs`` joined with a written ``side``; texts without a row in ``side`` are not moved if its ids can be broadcast."""
    names = [c for c in side.columns if c not in keys]
    if inner:
        return join_ids(docs, side.select("doc_id").distinct(), "left_semi").join(side, keys)
    if side.count() > BROADCAST_IDS:
        return docs.join(side, keys, "left")
    ids = side.select("doc_id").distinct()
    rest = join_ids(docs, ids, "left_anti").select("*", *[F.lit(None).cast(side.schema[c].dataType).alias(c) for c in names])
    return join_ids(docs, ids, "left_semi").join(side, keys, "left").unionByName(rest)


def removed_windows(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, text_hash, runs): the removed windows of each row, as ``start << 16 | mask`` of up to 16 windows.

    ``docs`` has doc_id, text_hash and text, no null ids and no two documents of the same words.
    """
    if window > DEPTH:
        raise ValueError(f"windows of more than {DEPTH} words need a deeper suffix order")
    found = stage(_anchors(docs, window, anchor), "anchors")
    each = found.select("doc_id", F.explode("anchors").alias("anchor"))
    common = each.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    often = F.collect_list(F.when(F.col("n") > frequent, F.col("anchor")))
    shared = stage(
        each.join(common.hint("shuffle_hash"), "anchor").groupBy("doc_id").agg(F.collect_list("anchor").alias("shared"), often.alias("frequent")),
        "shared",
    )
    occurring = shared.agg(F.sum(F.size("shared"))).first()[0] or 0
    shards = max(16, -(-int(occurring) * (2 * window) // SHARD_WORDS))
    segments = _segments(_with_side(docs, shared, ["doc_id"], True), shards, window, anchor)
    segments = stage(segments, "segments")
    contents = segments.groupBy("content").agg(F.min("doc_id").alias("holder"), F.first("words").alias("words"), F.first("shard").alias("shard"))
    least = stage(_search(contents, window), "least")
    places = segments.select("content", "doc_id", "text_hash", "start").join(least, "content")
    mask = F.aggregate(
        F.transform("least", lambda x, i: F.when(x < F.col("doc_id"), F.call_function("shiftleft", F.lit(1), i)).otherwise(0)),
        F.lit(0), lambda s, x: s.bitwiseOR(x),
    )
    runs = places.withColumn("mask", mask).where("mask != 0")
    packed = F.shiftleft(F.col("start").cast("long"), 16).bitwiseOR(F.col("mask").cast("long"))
    return runs.groupBy("doc_id", "text_hash").agg(F.collect_list(packed).alias("runs"))


def kept_words(raw: bytes, runs: np.ndarray, window: int = WINDOW) -> tuple[int, int, bytes]:
    """(words, removed words, the kept words joined by one space) of one text."""
    words = raw.split()  # bytes.split() splits at ASCII white space
    if not len(runs):
        return len(words), 0, b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    bits = (runs[:, None] >> np.arange(16)) & 1
    at = ((runs >> 16)[:, None] + np.arange(16))[bits == 1]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return len(words), int(covered.sum()), b" ".join([w for w, c in zip(words, covered.tolist()) if not c])


def deduplicate(
    docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, frequent: int = FREQUENT, id_col: str = "doc_id", text: str = "text",
    with_text: bool = False,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256[, kept_text]."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    sequences = stage(_sequences(docs.where("doc_id IS NOT NULL")), "sequences")
    firsts = sequences.where(F.col("n_words") >= window).groupBy("digest").agg(F.min("doc_id").alias("first"))
    # Written, so that both sides of the join are shuffled and a large group of copies can be split.
    copies = sequences.join(stage(firsts, "firsts"), "digest").where("doc_id != first").select("doc_id", "text_hash", "n_words")
    copies = stage(copies, "copies")
    rows = copies.select("doc_id", "text_hash").distinct().withColumn("copy", F.lit(True))
    rows = stage(rows, "copy-rows")
    marked = _with_side(docs.where("doc_id IS NOT NULL"), rows, ["doc_id", "text_hash"], False)
    single = marked.where("copy IS NULL").select("doc_id", "text_hash", "text")
    removed = stage(removed_windows(single, window, anchor, frequent), "removed")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, sums, texts = [], [], [], []
            for one, runs in zip(batch.column("text").cast(pa.large_binary()), batch.column("runs")):
                at = runs.values.to_numpy() if runs.is_valid else np.zeros(0, np.int64)
                words, lost, kept = kept_words(one.as_py() or b"", at, window)
                n.append(words)
                gone.append(lost)
                sums.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept.decode())
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sums, pa.string())]
            columns += [pa.array(texts, pa.string())] * with_text
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: len(columns)])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    whole = _with_side(single, removed, ["doc_id", "text_hash"], False)
    free = docs.where("doc_id IS NULL").withColumn("runs", F.lit(None).cast("array<long>"))
    done = whole.unionByName(free).select("doc_id", "text", "runs").mapInArrow(finish, schema)
    gone = copies.select("doc_id", "n_words", F.col("n_words").alias("n_removed"), F.sha2(F.lit(""), 256).alias("kept_sha256"))
    return done.unionByName(gone.withColumn("kept_text", F.lit("")) if with_text else gone)
