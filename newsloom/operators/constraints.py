"""Row constraints, key uniqueness and table defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.schemas import MAX_CATEGORY_CHARS


def keep_one_per_key(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``.

    Spark places a WindowGroupLimit before the exchange, so each map task sends
    at most one row per key and a hot key stays cheap.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def count_duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Row, key and duplicate counts."""
    per_key = rows.groupBy(key).agg(F.count("*").alias("n"))
    return per_key.agg(
        F.sum("n").alias("n_rows"),
        F.count("*").alias("n_keys"),
        F.sum(F.col("n") - 1).alias("n_duplicates"),
    )


def with_violations(rows: DataFrame, dim: int) -> DataFrame:
    """Add ``violations``: the names of the embedding-table constraints a row breaks."""
    checks = {
        "news_id_null": F.col("news_id").isNull(),
        "category_null": F.col("category").isNull(),
        "category_too_long": F.length("category") > MAX_CATEGORY_CHARS,
        "title_null": F.col("title").isNull(),
        "embedding_null": F.col("embedding").isNull(),
        "embedding_dim": F.col("embedding").isNotNull() & (F.size("embedding") != dim),
    }
    named = F.array(*[F.when(broken, F.lit(name)) for name, broken in checks.items()])
    return rows.withColumn("violations", F.array_compact(named))


def valid_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("violations") == 0).drop("violations")


def quarantined_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("violations") > 0)


def with_result_defaults(rows: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Fill what an insert leaves out: an empty audio list and both timestamps."""
    now = F.current_timestamp() if as_of is None else as_of
    filled = rows
    if "audio_files" in rows.columns:
        empty = F.array().cast(rows.schema["audio_files"].dataType)
        filled = filled.withColumn("audio_files", F.coalesce("audio_files", empty))
    for name in ("created_at", "updated_at"):
        filled = filled.withColumn(name, F.coalesce(F.col(name), now) if name in rows.columns else now)
    return filled
