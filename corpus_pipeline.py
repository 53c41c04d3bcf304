"""Documents to packed training windows in five stages: quality, exact dedup, near dedup, mixture, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written and read again as the next one's
documents. All but the last return the columns of documents.

Defined cases: a null, empty or short text is rejected by the first stage, as it has fewer than 50 words. Rows with a
null id are judged and mixed like others; the exact stage keeps one only where all of its group have none, and the near
stage links them with nothing. Rows that repeat both id and text stay together in the exact and the near stage, and are
mixed and packed as often. A null source is a source of its own. Ties go to the smaller id, in the exact stage after the
longer text. An empty table gives an empty result. Columns of any name pass through the first four stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clickrank.llm import exact_dedup, mixing, ngram_join, packing, quality_rules
from clickrank.session import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the default policy rejects go."""
    return quality_rules.filter_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document id of each group of equal texts stays; rows that repeat this id and text stay with it."""
    index = exact_dedup.new_index(spark)
    kept = exact_dedup.drop_duplicates(docs, index)
    index.drop()
    return kept


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays."""
    return ngram_join.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, the one at a source's cut in part."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 ids."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("ngram_jaccard", near),
    ("mixing", mixture),
    ("packing", packed),
]

#: Tokenizing cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
