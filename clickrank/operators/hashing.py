"""M1 without an encoder of one's own: news as hashed TF-IDF, sparse, with a document-frequency table.

A token belongs to the bucket that the first 32 bits of its MD5 name, so that any engine finds the same vectors. Counting
combines on the map side; the document frequencies are at most ``dim`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickrank.functions.tokens import tokens

MAX_DIM = 1 << 20  # buckets; bounds the frequency table, which is broadcast (16 MB at most)


def bucket(token: Column, dim: int) -> Column:
    """The token's bucket, from 0."""
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")


def term_counts(news_text: DataFrame, dim: int) -> DataFrame:
    """``(news_id, bucket, n)`` over all text columns; news without a token have no row."""
    texts = [c for c in news_text.columns if c != "news_id"]
    words = news_text.select("news_id", F.explode(tokens(F.concat_ws(" ", *texts))).alias("_token"))
    return words.groupBy("news_id", bucket(F.col("_token"), dim).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def document_frequencies(counts: DataFrame) -> DataFrame:
    """``(bucket, n_docs)``, one row per bucket in use."""
    return counts.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_docs"))


def hashed_tfidf(news_text: DataFrame, dim: int = 256) -> DataFrame:
    """``(news_id, buckets, weights)``: every news item as a sparse vector, ascending by bucket, empty without tokens.

    A weight is ``n * ln((N + 1) / (n_docs + 1))`` with N the news items; buckets that all items have weigh nothing and
    are kept with 0.
    """
    if not 0 < dim <= MAX_DIM:
        raise ValueError(f"dim is 1 to {MAX_DIM}, not {dim}")
    counts = term_counts(news_text, dim)
    total = news_text.agg(F.count(F.lit(1)).alias("_total"))
    idf = F.broadcast(document_frequencies(counts).join(F.broadcast(total)))
    weight = F.col("n") * F.log((F.col("_total") + 1) / (F.col("n_docs") + 1))
    weighed = counts.join(idf, "bucket").select("news_id", F.struct("bucket", weight.alias("weight")).alias("_entry"))
    # A row has at most dim entries.
    packed = weighed.groupBy("news_id").agg(F.array_sort(F.collect_list("_entry")).alias("_entries"))
    entries = F.coalesce("_entries", F.array().cast("array<struct<bucket:int,weight:double>>"))
    return news_text.select("news_id").join(packed, "news_id", "left").select(
        "news_id", F.transform(entries, lambda e: e["bucket"]).alias("buckets"),
        F.transform(entries, lambda e: e["weight"]).alias("weights"),
    )


def dense(sparse: DataFrame, dim: int) -> DataFrame:
    """``(news_id, vec)`` from a sparse vector, for the operators that pool."""
    held = F.map_from_arrays("buckets", "weights")
    places = F.sequence(F.lit(0), F.lit(dim - 1))
    return sparse.select("news_id", F.transform(places, lambda i: F.coalesce(F.try_element_at(held, i), F.lit(0.0))).alias("vec"))
