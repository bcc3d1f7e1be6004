"""Index statistics and batch tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total_indexed(index: DataFrame) -> DataFrame:
    return index.agg(F.count("*").alias("total_embeddings"))


def count_by_category(index: DataFrame) -> DataFrame:
    return index.groupBy("category").agg(F.count("*").alias("n"))


def index_stats(index: DataFrame) -> DataFrame:
    """One record: the total and a category-to-count map, built from the per-category counts."""
    pairs = F.sort_array(F.collect_list(F.struct("category", "n")))
    return count_by_category(index).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_embeddings"),
        F.map_from_entries(pairs).alias("by_category"),
    )


def tally_counts() -> list[Column]:
    """The counts of a statused batch, as an aggregate or for an observation of one."""
    status = F.col("status")
    skipped = status.isin("already_indexed", "no_title")
    counts = {"indexed": status == "indexed", "skipped": skipped}
    counts |= {name: status == name for name in ("already_indexed", "no_title", "invalid")}
    return [F.count_if(which).alias(name) for name, which in counts.items()]


def tally(statused: DataFrame) -> DataFrame:
    """Counts of a statused batch; ``skipped`` is already indexed or without a title."""
    return statused.agg(*tally_counts())
