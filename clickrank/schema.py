"""Declared schemas, sentinels and fixed constants."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values.
EMPTY_NEWS_ID = "EMPTY_NEWS_ID"
UNKNOWN_USER_IDX = 0
FILLER_POS = -1

# Token ids with a reserved meaning; ordinary tokens follow.
PAD_ID, UNK_ID, CLS_ID, SEP_ID = 0, 1, 2, 3
FIRST_TOKEN_ID = 4

# Strings the pandas CSV reader documents as missing by default.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Columns of the news file, in order.
NEWS_COLUMNS = (
    "news_id", "category", "subcategory", "title", "abstract", "url", "title_entities", "abstract_entities",
)
ENTITY_COLUMNS = ("title_entities", "abstract_entities")

NEWS_FILE = T.StructType([T.StructField(c, T.StringType()) for c in NEWS_COLUMNS])

BEHAVIOR_FILE = T.StructType(
    [
        T.StructField("impression_id", T.LongType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("time", T.StringType()),
        T.StructField("history_str", T.StringType()),
        T.StructField("impressions_str", T.StringType()),
    ]
)

DESCRIPTION_FILE = T.StructType(
    [T.StructField("category", T.StringType()), T.StructField("description", T.StringType())]
)
