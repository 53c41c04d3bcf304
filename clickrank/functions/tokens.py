"""Whitespace tokens and token budgets as column expressions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


SPACES = "[ \t\n]+"


def tokens(text: Column) -> Column:
    """Tokens between spaces, tabs and newlines."""
    return F.filter(F.split(text, SPACES), lambda t: t != "")


def first_tokens(text: Column, n: int) -> Column:
    """The first ``n`` tokens. Splitting stops once they are found: besides them there can only be an empty
    string in front and the unsplit rest."""
    return F.slice(F.filter(F.split(text, SPACES, n + 2), lambda t: t != ""), 1, n)


def token_count(text: Column, tokenizer: Callable[[str], list] | None = None) -> Column:
    """Tokens per text, by whitespace or by a given tokenizer (Arrow batches)."""
    if tokenizer is None:
        return F.coalesce(F.size(tokens(text)), F.lit(0))

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: 0 if t is None else len(tokenizer(t)))

    return count(text)


def pair_budgets(first: Column, second: Column, budget: int) -> tuple[Column, Column]:
    """Tokens kept of each side when the longer one is trimmed until both fit ``budget`` together.

    If both sides exceed half the budget they share it, and the longer side (the second one when equal)
    takes the odd token.
    """
    half, rest = budget // 2, budget - budget // 2
    short = F.least(first, second)

    def keep(this: Column, longer: Column) -> Column:
        return (
            F.when(first + second <= budget, this)
            .when(short > half, F.when(longer, F.lit(rest)).otherwise(F.lit(half)))
            .when(longer, F.lit(budget) - short)
            .otherwise(this)
        )

    return keep(first, first > second), keep(second, first <= second)
