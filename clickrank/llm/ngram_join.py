"""Jaccard self-join of documents on word n-grams: rare-first prefixes, length, positional and suffix filters.

1. Counts of the frequent shingles, gathered by task and summed, give the global order "rare first, then by hash". Any
   total order is right; this one moves frequent shingles out of the prefixes.
2. Equal sets are one class, named by its smallest id. A class of n shingles has a prefix of n - ceil(t n) + 1, and two
   classes that link share the first of their common shingles in both prefixes.
3. Prefix shingles of a single class are dropped. In each remaining bucket the member with the earliest position leads;
   it is paired with all others, which joins a family of near copies with as many pairs as members.
4. Members that still lie in different components are paired bucket by bucket: rows that cannot reach the threshold
   with any row of their bucket go first, then the length bins, the positional filter and the components cut the join.
   A pair inside one component cannot change it and is not looked at.
5. Pairs pass the suffix filter (the sets' sizes within 64 fixed hash ranges bound the overlap) and are verified once,
   by intersecting whole sets of 64-bit hashes.

``jaccard_components`` is the cheaper form for components only: it finds as many links as the components need.
``jaccard_links`` is the whole join: every link between classes, and the documents of each class. It leaves out the
stars of step 3 and the components of step 4, so a family of near copies costs all its pairs.

Defined cases: null or empty texts, and texts without words, have an empty set and link with nothing; rows that repeat
an id are one document that links if any of its texts does; a row with a null id keeps a null component; ties are
broken by id; an empty table gives an empty result; other columns are ignored. A text costs memory in proportion to its
length once, in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickrank.llm import textbatch as tb
from clickrank.llm.tables import components, join_ids
from clickrank.session import stage

LISTED = 1 << 18     # frequent shingles with a count of their own: 4 MB, broadcast
PER_TASK = 1 << 14   # frequent shingles that a task reports
STEP = 1 << 19       # shingles that a task counts at once: 4 MB
RANGES = 64          # hash ranges of the suffix filter
MOST = 127           # a range's size is cut here, to be one byte


@dataclass(frozen=True)
class Similarity:
    """``width`` words a shingle; a link needs ``parts * intersection >= least * union``."""

    width: int = 5
    least: int = 80
    parts: int = 100

    def prefix(self, n: int) -> int:
        return n - -(-self.least * n // self.parts) + 1

    def overlaps(self, overlap: Column, n_a: Column, n_b: Column) -> Column:
        """Is the overlap enough for two sets of these sizes?"""
        return (self.parts + self.least) * overlap >= self.least * (n_a + n_b)

    def sizes(self, n_a: Column, n_b: Column) -> Column:
        return self.parts * F.least(n_a, n_b) >= self.least * F.greatest(n_a, n_b)


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    for first, end, data, offsets in tb.pieces(batch.column("text")):
        starts, ends, words = tb.word_spans(data, offsets)
        hashes = tb.word_hashes(data, starts, ends, lower=True)
        for i in range(end - first):
            yield first + i, tb.shingle_set(hashes[words[i] : words[i + 1]], width)


def _frequent(shingles: np.ndarray, counts: np.ndarray, held: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``held`` most frequent shingles, those of one document left out; ties by hash."""
    twice = counts > 1
    shingles, counts = shingles[twice], counts[twice]
    if len(shingles) > held:
        best = np.sort(np.lexsort((shingles, -counts))[:held])
        shingles, counts = shingles[best], counts[best]
    return shingles, counts


def _added(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    shingles, at = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    return shingles, np.bincount(at, np.concatenate([a[1], b[1]]), len(shingles)).astype(np.int64)


def frequent_shingles(docs: DataFrame, width: int, listed: int = LISTED, per_task: int = PER_TASK) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, counts) of the shingles that many documents have, over all rows; ``listed`` of them at most.

    A task counts its rows in steps and keeps the ``per_task`` most frequent shingles of each; counts of tasks are summed.
    Shingles that are too rare to be listed count as one. What is listed decides about costs alone, as any total order
    of shingles gives the same links.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        step, size = [], 0
        for batch in batches:
            for _, found in _sets(batch, width):
                step.append(found)
                size += len(found)
                if size >= STEP:
                    held = _frequent(*_added(held, np.unique(np.concatenate(step), return_counts=True)), per_task)
                    step, size = [], 0
        if step:
            held = _added(held, np.unique(np.concatenate(step), return_counts=True))
        shingles, counts = _frequent(*held, per_task)
        yield pa.RecordBatch.from_arrays([pa.array(shingles.view(np.int64)), pa.array(counts)], ["shingle", "n"])

    summed = stage(docs.mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")), "frequent")
    # The least count of which there are few enough, from a histogram of powers of two.
    sizes = sorted(summed.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).count().collect(), reverse=True)
    least, total = None, 0
    for power, n in sizes:
        total += n
        if total > listed:
            break
        least = 1 << power
    rows = summed.where(F.col("n") >= least if least else F.lit(False)).toArrow()
    shingles = rows.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], rows.column("n").to_numpy()[order]


def _lists(values: list[np.ndarray], dtype: type) -> pa.ListArray:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0, dtype)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(dtype)))


def _counts_of(found: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Listed counts of sorted shingles, 1 for those not listed."""
    shingles, counts = frequent
    if not len(shingles):
        return np.ones(len(found), np.int64)
    at = np.minimum(np.searchsorted(shingles, found), len(shingles) - 1)
    return np.where(shingles[at] == found, counts[at], 1)


def prefixes(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], how: Similarity) -> DataFrame:
    """Per row: doc_id, n, digest of the set, sizes by hash range up to ``MOST``, and the prefix in global order."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            n, digests, ranges, tokens = [], [], [], []
            for _, found in _sets(batch, how.width):
                rare = np.lexsort((found, _counts_of(found, known)))
                n.append(len(found))
                digests.append(hashlib.md5(found.tobytes()).digest())
                ranges.append(np.minimum(np.bincount((found >> np.uint64(58)).astype(np.int64), minlength=RANGES), MOST))
                tokens.append(found[rare[: how.prefix(len(found)) if len(found) else 0]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int32()), pa.array(digests, pa.binary()),
                 _lists(ranges, np.int8), _lists(tokens, np.int64)],
                ["doc_id", "n", "digest", "ranges", "tokens"],
            )

    return docs.mapInArrow(cut, "doc_id long, n int, digest binary, ranges array<tinyint>, tokens array<long>")


def _whole_sets(docs: DataFrame, width: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.view(np.int64) for _, s in _sets(batch, width)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(found, np.int64)], ["doc_id", "shingles"])

    return docs.mapInArrow(cut, "doc_id long, shingles array<long>")


def _apart(a: str, b: str) -> Column:
    """Least possible size of the symmetric difference, from the sizes within hash ranges.

    Sizes that were cut at ``MOST`` differ by no more than the whole ones.
    """
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("int") - y)), F.lit(0), lambda s, x: s + x)


def _verified(docs: DataFrame, rows: DataFrame, pairs: DataFrame, how: Similarity) -> DataFrame:
    """The pairs (a, b) that link: suffix filter on the small rows, then whole sets of what is left."""
    a, b = (rows.select(F.col("doc_id").alias(s), F.col("n").alias(f"n_{s}"), F.col("ranges").alias(f"ranges_{s}")) for s in "ab")
    fits = how.overlaps((F.col("n_a") + F.col("n_b") - _apart("ranges_a", "ranges_b")) / 2, F.col("n_a"), F.col("n_b"))
    left = pairs.join(a, "a").join(b, "b").where(fits)
    left = stage(left.select("a", "b").distinct(), "pairs")
    wanted = stage(left.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "wanted")
    sets = stage(_whole_sets(join_ids(docs, wanted, "left_semi"), how.width), "sets")
    both = left.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a")), "a").join(
        sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b")), "b"
    )
    overlap = F.size(F.array_intersect("set_a", "set_b"))
    return stage(both.where(how.overlaps(overlap, F.size("set_a"), F.size("set_b"))).select("a", "b").distinct(), "links")


def _open_pairs(buckets: DataFrame, found: DataFrame, labels: DataFrame, how: Similarity) -> DataFrame:
    """Pairs of a bucket that may link and lie in different components (node, component); without labels, all that may link.

    All filters are conditions of the join, so that only pairs near the threshold leave it.
    """
    rows = buckets.join(labels, buckets["cls"] == labels["node"], "left").select(
        "token", "pos", "n", "cls", F.coalesce("component", "cls").alias("component")
    )
    rest = F.col("n") - F.col("pos")

    def still_open(rows: DataFrame) -> DataFrame:
        bounds = rows.groupBy("token").agg(
            F.min("component").alias("_low"), F.max("component").alias("_high"),
            F.min("n").alias("_least"), F.max(rest).alias("_rest"),
        )
        # Written, so that both sides of the join are shuffled and a hot token can be split.
        bounds = stage(bounds.where("_low < _high").drop("_low", "_high"), "bounds")
        other = F.greatest(F.col("_least"), F.ceil(F.col("n") * how.least / how.parts))
        fits = how.overlaps(F.least(rest, F.col("_rest")), F.col("n"), other)
        return rows.join(bounds, "token").where(fits).select(rows.columns)

    rows = stage(still_open(stage(still_open(stage(rows, "labelled")), "open")), "open")
    ranges = found.select(F.col("doc_id").alias("cls"), "ranges")
    rows = stage(rows.join(ranges, "cls"), "open")
    # Sets that link lie in one length bin or in two next to each other; the smaller set of a pair is on side a.
    size = F.floor(F.log(F.col("n")) / float(np.log(how.parts / how.least)) + 1e-9).cast("int")  # borders go up in any rounding
    a = rows.select(*[F.col(c).alias(f"{c}_a") for c in rows.columns], size.alias("bin"))
    b = rows.select(*[F.col(c).alias(f"{c}_b") for c in rows.columns], F.explode(F.array(size, size - 1)).alias("bin"))
    ahead = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("cls_a") < F.col("cls_b")))
    meet = (
        (a["token_a"] == b["token_b"]) & (a["bin"] == b["bin"]) & ahead
        & (F.col("component_a") != F.col("component_b")) & how.sizes(F.col("n_a"), F.col("n_b"))
        & how.overlaps(F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")), F.col("n_a"), F.col("n_b"))
        & how.overlaps((F.col("n_a") + F.col("n_b") - _apart("ranges_a", "ranges_b")) / 2, F.col("n_a"), F.col("n_b"))
    )
    return a.join(b, meet).select(F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b")).distinct()


def _buckets(found: DataFrame, classes: DataFrame) -> DataFrame:
    """Prefix shingles of the classes' first documents, those of a single class dropped."""
    rows = found.join(classes.select(F.col("cls").alias("doc_id")).distinct(), "doc_id", "left_semi").where("n > 0")
    tokens = rows.select(F.posexplode("tokens").alias("pos", "token"), "n", F.col("doc_id").alias("cls"))
    shared = tokens.groupBy("token").count().where("count > 1").select("token")
    return stage(tokens.join(shared.hint("shuffle_hash"), "token"), "buckets")


def jaccard_components(docs: DataFrame, how: Similarity = Similarity(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles and component_id, the smallest id reachable by links."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = stage(prefixes(docs, frequent_shingles(docs, how.width), how), "prefixes")
    classes = found.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("cls"))
    buckets = _buckets(found, classes)

    first = F.struct("pos", "n", "cls")
    # Written, here and below, so that both sides of the join are shuffled and a hot key can be split.
    leads = stage(buckets.groupBy("token").agg(F.min(first).alias("lead")), "leads")
    led = buckets.join(leads, "token").where("cls != lead.cls")
    fits = how.sizes(F.col("n"), F.col("lead.n")) & how.overlaps(
        F.least(F.col("n") - F.col("pos"), F.col("lead.n") - F.col("lead.pos")), F.col("n"), F.col("lead.n")
    )
    stars = led.where(fits).select(F.least("cls", "lead.cls").alias("a"), F.greatest("cls", "lead.cls").alias("b")).distinct()

    links = _verified(docs, found, stars, how)
    more = _verified(docs, found, _open_pairs(buckets, found, components(links), how), how)
    again = found.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id")
    same = found.join(again, "doc_id").join(classes, "digest").where("cls != doc_id").select(F.col("cls").alias("a"), F.col("doc_id").alias("b"))
    labels = components(links.union(more).union(same))
    named = classes.join(labels, classes["cls"] == labels["node"], "left").select(
        F.col("digest").alias("_digest"), F.coalesce("component", "cls").alias("component")
    )
    alone = F.when(F.col("doc_id").isNotNull(), F.least(F.coalesce("component", "doc_id"), "doc_id"))
    named = stage(named, "named")
    return found.join(named, (found["digest"] == named["_digest"]) & (found["n"] > 0), "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), alone.alias("component_id")
    )


def jaccard_links(docs: DataFrame, how: Similarity = Similarity(), id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links between classes of equal sets, (a, b) with a < b, and the members (doc_id, cls, n_shingles) of each class.

    Documents of one class link with each other, and with those of every linked class. Classes are numbered by rows, not
    ids, because the texts of a repeated id may be of several classes; texts are written once with these numbers.
    Rows with a null id and rows without shingles are no members.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).alias("text")).where("_id IS NOT NULL")
    rows = stage(rows.withColumn("doc_id", F.monotonically_increasing_id()), "rows")
    docs = rows.select("doc_id", "text")
    found = stage(prefixes(docs, frequent_shingles(docs, how.width), how), "prefixes")
    classes = stage(found.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("cls")), "classes")
    nothing = docs.sparkSession.createDataFrame([], "node long, component long")
    links = _verified(docs, found, _open_pairs(_buckets(found, classes), found, nothing, how), how)
    members = found.where("n > 0").join(classes, "digest").join(rows.select("doc_id", "_id"), "doc_id")
    return links, members.select(F.col("_id").alias("doc_id"), "cls", F.col("n").cast("long").alias("n_shingles")).distinct()


def document_links(links: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of documents (a, b), a < b, that link: within a class and over its links."""
    near = links.union(members.select("cls", "cls").distinct())
    a, b = (members.select(F.col("doc_id").alias(f"doc_{s}"), F.col("cls").alias(s)) for s in "ab")
    both = near.join(a, "a").join(b, "b").where("doc_a != doc_b")
    return both.select(F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b")).distinct()


def keep_one(docs: DataFrame, how: Similarity = Similarity()) -> DataFrame:
    """``docs`` without those that link, directly or over others, to a document of smaller id."""
    gone = jaccard_components(docs, how).where("component_id < doc_id").select("doc_id").distinct()
    return join_ids(docs, stage(gone, "near-copies"), "left_anti")
