"""JSON form of result lists, used only where a table meets a key-value store."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.schemas import ALL_CATEGORIES_KEY, RECOMMENDED


def encode_items(items: Column) -> Column:
    return F.to_json(items, {"ignoreNullFields": "false"})


def decode_items(payload: Column) -> Column:
    return F.from_json(payload, T.ArrayType(RECOMMENDED))


def category_key(category_filter: Column) -> Column:
    """A missing or empty filter means every category."""
    absent = category_filter.isNull() | (category_filter == "")
    return F.when(absent, ALL_CATEGORIES_KEY).otherwise(category_filter)


def cache_key(news_id: Column, k: Column, key: Column) -> Column:
    return F.concat_ws(":", F.lit("rec"), news_id.cast("string"), k.cast("string"), key)
