"""Category descriptions: generation, storage, statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickrank.operators.text import (
    description_length_stats,
    generate_descriptions,
    generation_prompts,
    unique_categories,
)
from clickrank.sources.files import read_descriptions, write_descriptions


def describe_categories(
    train_news: DataFrame,
    val_news: DataFrame,
    generate_fn: Callable[[str, str], str],
    path: str,
    system_prompt: str,
    level: str = "subcategory",
    max_attempts: int = 5,
) -> DataFrame:
    """The stored descriptions; raises when some categories could not be described."""
    prompts = generation_prompts(unique_categories(train_news, val_news, level), system_prompt)
    answers = generate_descriptions(prompts, generate_fn, max_attempts)
    failed = [r["category"] for r in answers.where(F.col("error").isNotNull()).orderBy("category").take(5)]
    if failed:
        raise RuntimeError(f"no description for {failed}")
    write_descriptions(answers, path)
    return read_descriptions(train_news.sparkSession, path, lines=True)


def description_statistics(spark: SparkSession, path: str, tokenizer: Callable[[str], list] | None = None) -> DataFrame:
    """S3, T8, A5."""
    return description_length_stats(read_descriptions(spark, path), tokenizer)
