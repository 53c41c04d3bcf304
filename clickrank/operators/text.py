"""Category descriptions, prompts, vocabularies and token ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickrank.functions.tokens import SPACES, first_tokens, pair_budgets, token_count, tokens
from clickrank.operators.lookup import attach_description
from clickrank.operators.scale import dense_index, fits_broadcast, lookup
from clickrank.schema import CLS_ID, FIRST_TOKEN_ID, PAD_ID, SEP_ID, UNK_ID
from clickrank.session import stage

# Wording of the templated description and of the request for a generated one.
TEMPLATE_WORDS = "The category is "
REQUEST_WORDS = "The news category is "

# Names of the text methods.
TITLE_ONLY = "none"
TEMPLATE = "template_based"
GENERATED = ("gpt4", "gpt35", "llama2_13b")

def template_text(name: Column) -> Column:
    return F.concat(F.lit(TEMPLATE_WORDS), name)


def template_descriptions(names: DataFrame, column: str = "category") -> DataFrame:
    """A templated description for each name of the given list."""
    return names.select(F.col(column).alias("category"), template_text(F.col(column)).alias("description"))


def news_text(
    news: DataFrame, method: str, descriptions: DataFrame | None = None, strict: bool = False
) -> DataFrame:
    """The text that stands for a news item under a method.

    ``none`` keeps the title; ``template_based`` adds the template, for the names in ``descriptions`` or for
    any subcategory when none are given; a generated method adds its own table of descriptions.
    """
    if method == TITLE_ONLY:
        return news.select("news_id", "title")
    if method == TEMPLATE:
        if descriptions is not None:
            return attach_description(news, template_descriptions(descriptions), strict)
        return news.select("news_id", "title", template_text(F.col("subcategory")).alias("category_description"))
    if method in GENERATED:
        if descriptions is None:
            raise ValueError(f"method {method} needs a table of descriptions")
        return attach_description(news, descriptions, strict)
    raise ValueError(f"unknown text method: {method}")


def unique_categories(train_news: DataFrame, val_news: DataFrame, level: str = "subcategory") -> DataFrame:
    """A4: distinct names of this level (``category`` or ``subcategory``) over both splits."""
    name = F.col(level).alias("category")
    return train_news.select(name).distinct().unionByName(val_news.select(name).distinct()).distinct()


def generation_prompts(categories: DataFrame, system_prompt: str) -> DataFrame:
    """What a text generator is asked for each category."""
    return categories.select(
        "category",
        F.lit(system_prompt).alias("system_prompt"),
        F.concat(F.lit(REQUEST_WORDS), F.col("category")).alias("user_prompt"),
    )


def generate_descriptions(
    prompts: DataFrame, generate_fn: Callable[[str, str], str], max_attempts: int = 5, parallel: int = 10
) -> DataFrame:
    """T4: ``(category, description, error)`` from a text generator called in ``parallel`` tasks.

    Each round is written before the next, so an answer is not asked for twice; only the failed categories
    are asked again. What still fails after ``max_attempts`` rounds comes back with its error.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = []
            for category, system, user in zip(batch["category"], batch["system_prompt"], batch["user_prompt"]):
                try:
                    answers.append((category, system, user, generate_fn(system, user), None))
                except Exception as failure:  # any failure of the service counts as one attempt
                    answers.append((category, system, user, None, str(failure) or type(failure).__name__))
            yield pd.DataFrame(answers, columns=["category", "system_prompt", "user_prompt", "description", "error"])

    schema = "category string, system_prompt string, user_prompt string, description string, error string"
    fields = ("category", "description", "error")
    answered, pending = None, prompts
    for attempt in range(1, max_attempts + 1):
        outcome = stage(pending.repartition(parallel, "category").mapInPandas(ask, schema), "descriptions")
        failed = outcome.where(F.col("error").isNotNull())
        done = outcome.where(F.col("error").isNull()).select(*fields)
        answered = done if answered is None else answered.unionByName(done)
        if failed.isEmpty():
            return answered
        if attempt == max_attempts:
            return answered.unionByName(failed.select(*fields))
        pending = failed.select("category", "system_prompt", "user_prompt")
    raise ValueError("max_attempts must be at least 1")


def description_length_stats(
    descriptions: DataFrame, tokenizer: Callable[[str], list] | None = None, column: str = "description"
) -> DataFrame:
    """A5: number of descriptions and the largest, smallest and mean token count."""
    n = token_count(F.col(column), tokenizer)
    return descriptions.select(n.alias("_n")).agg(
        F.count(F.lit(1)).alias("category_count"),
        F.max("_n").alias("max_description_length"),
        F.min("_n").alias("min_description_length"),
        F.avg("_n").alias("avg_description_length"),
    )


def build_vocab(df: DataFrame, column: str, min_count: int = 1, size: int | None = None) -> DataFrame:
    """``(token, n, id)`` for the tokens of a text column, the most frequent first."""
    counts = (
        df.select(F.explode(F.split(column, SPACES)).alias("token")).where(F.col("token") != "")
        .groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    )
    vocab = dense_index(counts, [F.col("n").desc(), F.col("token").asc()], "id", FIRST_TOKEN_ID)
    return vocab if size is None else vocab.where(F.col("id") < FIRST_TOKEN_ID + size)


def _token_ids(df: DataFrame, key: str, sides: list[tuple[str, Column]], vocab: DataFrame) -> DataFrame:
    """Per row the ids of each side's kept tokens, in order; both sides in one join and one regrouping."""

    def marked(side: str, kept: Column) -> Column:
        return F.transform(kept, lambda t, i: F.struct(F.lit(side).alias("side"), i.alias("at"), t.alias("token")))

    known = vocab.select("token", F.col("id").cast("int").alias("id"))
    fits = fits_broadcast(known)
    packed = df.select(F.col(key), F.concat(*[marked(side, kept) for side, kept in sides]).alias("_kept"))
    if fits:
        # The few kept tokens are placed by row before they are unrolled; the broadcast join leaves them there.
        packed = packed.repartition(key)
    # A row without tokens stays, as one without a side.
    found = lookup(packed.select(key, F.inline_outer("_kept")), known, "token", fits=fits)
    item = F.struct("at", F.coalesce("id", F.lit(UNK_ID)).alias("id"))
    # At most max_length items per row, since only kept tokens are joined.
    grouped = found.groupBy(key).agg(
        *[F.array_sort(F.collect_list(F.when(F.col("side") == side, item))).alias(f"_{side}") for side, _ in sides]
    )
    return grouped.select(key, *[F.col(f"_{side}.id").alias(f"_{side}_ids") for side, _ in sides])


def _padded(ids: Column, max_length: int) -> list[Column]:
    length = F.size(ids)
    pads = F.array_repeat(F.lit(PAD_ID), F.lit(max_length) - length)
    return [F.concat(ids, pads).alias("input_ids"), length.alias("n_ids")]


def encode_texts(df: DataFrame, key: str, column: str, vocab: DataFrame, max_length: int) -> DataFrame:
    """T5: ``[CLS] text [SEP]`` as ids, truncated and padded to ``max_length``. ``key`` identifies the row."""
    kept = F.coalesce(first_tokens(F.col(column), max_length - 2), F.array().cast("array<string>"))
    ids = _token_ids(df, key, [("a", kept)], vocab)
    sequence = F.concat(F.array(F.lit(CLS_ID)), F.col("_a_ids"), F.array(F.lit(SEP_ID)))
    return ids.select(key, *_padded(sequence, max_length))


def encode_text_pairs(
    df: DataFrame, key: str, first: str, second: str, vocab: DataFrame, max_length: int
) -> DataFrame:
    """``[CLS] first [SEP] second [SEP]`` as ids; the longer text is trimmed until both fit."""
    none = F.array().cast("array<string>")
    split = df.select(
        key, F.coalesce(tokens(F.col(first)), none).alias("_a"), F.coalesce(tokens(F.col(second)), none).alias("_b")
    )
    keep_a, keep_b = pair_budgets(F.size("_a"), F.size("_b"), max_length - 3)
    sides = [("a", F.slice("_a", F.lit(1), keep_a)), ("b", F.slice("_b", F.lit(1), keep_b))]
    ids = _token_ids(split, key, sides, vocab)
    sep = F.array(F.lit(SEP_ID))
    sequence = F.concat(F.array(F.lit(CLS_ID)), F.col("_a_ids"), sep, F.col("_b_ids"), sep)
    return ids.select(key, *_padded(sequence, max_length))
