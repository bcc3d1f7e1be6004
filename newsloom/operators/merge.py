"""Upsert and delete on keyed tables, as new table contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.constraints import with_result_defaults
from newsloom.sources.articles import matching_keys


def merged_updates(updates: DataFrame, key: str = "news_id", order: str | None = None) -> DataFrame:
    """One row per key: of each column the first value that is not null.

    Updates with a larger ``order`` come first; among equal ones, or without an
    order, larger values do. Columns are settled one by one, so updates that each
    bring another column all count. Partial results are combined before the
    exchange, which keeps a hot key cheap.
    """
    produced = [c for c in updates.columns if c not in (key, order)]
    place = lambda c: F.struct(*([order] if order else []), c)
    first = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), place(c))).alias(c) for c in produced]
    return updates.groupBy(key).agg(*first) if first else updates.select(key).distinct()


def upsert(existing: DataFrame, updates: DataFrame, as_of: Column, key: str = "news_id", order: str | None = None) -> DataFrame:
    """Update the columns that ``updates`` carries, keep the others, insert new keys.

    A null in ``updates`` means "not produced". ``created_at`` survives and
    ``updated_at`` moves only on touched rows. The existing table is on the
    streamed side of a left join, so a small batch is broadcast and the stored
    text is not shuffled. Several updates of one key become one by :func:`merged_updates`.
    """
    produced = [c for c in updates.columns if c not in (key, order)]
    updates = merged_updates(updates, key, order)
    new = updates.select(key, F.lit(True).alias("_touched"), *[F.col(c).alias(f"_new_{c}") for c in produced])
    joined = existing.join(new, key, "left")
    columns = []
    for name in existing.columns:
        if name in produced:
            columns.append(F.coalesce(f"_new_{name}", name).alias(name))
        elif name == "updated_at":
            columns.append(F.when(F.col("_touched"), as_of).otherwise(F.col(name)).alias(name))
        else:
            columns.append(F.col(name))
    kept = joined.select(columns)

    known = matching_keys(existing, updates, key)
    inserted = updates.join(known, key, "left_anti")
    for field in existing.schema:
        if field.name not in inserted.columns and field.name not in ("created_at", "updated_at"):
            inserted = inserted.withColumn(field.name, F.lit(None).cast(field.dataType))
    inserted = with_result_defaults(inserted, as_of)
    return kept.unionByName(inserted.select(existing.columns))


def delete_keys(existing: DataFrame, keys: DataFrame, key: str = "news_id") -> DataFrame:
    """The table without the rows whose key is listed."""
    return existing.join(keys.select(key), key, "left_anti")


def deletion_report(existing: DataFrame, keys: DataFrame, key: str = "news_id") -> DataFrame:
    """For each listed key, whether there is a row to delete."""
    found = matching_keys(existing, keys, key).withColumn("deleted", F.lit(True))
    return (
        keys.select(key)
        .join(found, key, "left")
        .withColumn("deleted", F.coalesce("deleted", F.lit(False)))
    )
