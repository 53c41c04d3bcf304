"""The registered query of each operator, over its whole table, and its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickrank.llm import (
    chat_quotes, exact_dedup, filter_audit, hard_negatives, kd_search, line_dedup, mixing, ngram_join, packing,
    quality_rules, secret_scan, substring_dedup, token_output,
)
from clickrank.session import scratch_path


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without the words of 13-word windows that a document of smaller id has."""
    return substring_dedup.deduplicate(read(spark, folder, "documents"))


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as one batch of a new index."""
    index = exact_dedup.new_index(spark)
    decided = exact_dedup.deduplicate(read(spark, folder, "documents"), index)
    index.drop()
    return decided.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose sets of four-word shingles have a Jaccard similarity of 0.85 or more."""
    return ngram_join.jaccard_components(read(spark, folder, "documents"), ngram_join.Similarity(4, 85, 100))


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger of all documents and the verdicts of the base and the default policy."""
    found = quality_rules.ledger(read(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.keeps(F.col("fail_bits"), "v1")).alias("base_failed"),
        quality_rules.keeps(F.col("fail_bits")).alias("kept"),
        "fail_bits",
    )


def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of secrets in all documents, with the words of all of them as a dictionary."""
    docs = read(spark, folder, "documents")
    return secret_scan.scan(docs, ranks=secret_scan.word_ranks(docs))


def op6_token_output(spark: SparkSession, folder: str) -> DataFrame:
    """All documents written as token files and read back."""
    path = scratch_path(spark, "tokens")
    token_output.write_tokens(read(spark, folder, "documents"), path)
    return token_output.token_index(spark, path)


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of 40 or more code points in 5 or more documents stay in the document of the largest id only."""
    found = line_dedup.drop_lines(read(spark, folder, "documents").select("doc_id", "text"))
    lines = found["_lines"]
    return found.select("doc_id", lines["n_lines"].alias("n_lines"), lines["n_dropped"].alias("n_dropped"), F.sha2(lines["text"], 256).alias("kept_sha256"))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents mixed at weights 5, 2, 1 by source, three epochs at most."""
    mixed = mixing.mix(read(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op9_chat_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations in reply order, without quotes."""
    return chat_quotes.reply_order(read(spark, folder, "conversations"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into windows of 2048 ids."""
    return packing.pack(read(spark, folder, "documents"))


def op11_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best other vectors of every row whose id is divisible by 100, against all rows."""
    return kd_search.top_k(read(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Five filters in all 120 orders over all documents, by language."""
    return filter_audit.audit_documents(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Three hard negatives for five positives of every row whose id is divisible by 50, against all rows."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, label)


REGISTERED: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_ngram_join": op3_ngram_join,
    "op4_quality_rules": op4_quality_rules,
    "op5_secret_scan": op5_secret_scan,
    "op6_token_output": op6_token_output,
    "op7_line_dedup": op7_line_dedup,
    "op8_mixing": op8_mixing,
    "op9_chat_quotes": op9_chat_quotes,
    "op10_packing": op10_packing,
    "op11_exact_topk": op11_exact_topk,
    "op12_filter_audit": op12_filter_audit,
    "op13_hard_negatives": op13_hard_negatives,
}
