"""Incremental indexing: one code path for a snapshot and for a stream's micro-batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.text import category_or_unknown, embedding_input, has_text
from newsloom.operators.constraints import keep_one_per_key, quarantined_rows, valid_rows, with_violations
from newsloom.operators.embedding import Embedder, get_embedder
from newsloom.operators.stats import tally_counts
from newsloom.schemas import EMBEDDING, MAX_CATEGORY_CHARS
from newsloom.sources.articles import matching_keys
from newsloom.sources.batches import BatchTable


def not_indexed(articles: DataFrame, index: DataFrame) -> DataFrame:
    """Articles whose id is not in the index. The index's ids are only probed, see ``matching_keys``."""
    known = matching_keys(index.select(F.col("news_id").alias("id")), articles, "id")
    return articles.join(known, "id", "left_anti")


def already_indexed(articles: DataFrame, index: DataFrame) -> DataFrame:
    known = matching_keys(index.select(F.col("news_id").alias("id")), articles, "id")
    return articles.join(known, "id", "left_semi")


def with_categories(requests: DataFrame, articles: DataFrame) -> DataFrame:
    """Category by id from the whole article table; an unknown id gets the default category."""
    known = articles.select(F.col("id").alias("news_id"), "category")
    return requests.join(known, "news_id", "left").withColumn("category", category_or_unknown(F.col("category")))


def fill_categories(articles: DataFrame, catalog: DataFrame) -> DataFrame:
    """Articles with a missing category looked up by id in the whole article table; others are left as they are.

    Of several entries of one id, the first non-empty category in their order counts.
    """
    known = catalog.where(has_text(F.col("category"))).groupBy("id").agg(F.min("category").alias("_found"))
    missing = ~has_text(F.col("category")) | F.col("category").isNull()
    # Only ids that need it ask, and the table is on the streamed side of that join.
    asked = matching_keys(known, articles.where(missing), "id")
    found = articles.join(known.join(asked, "id"), "id", "left")
    return found.withColumn("category", F.when(missing, F.col("_found")).otherwise(F.col("category"))).select(articles.columns)


def mark_indexed(statused: DataFrame, as_of: Column, epochs: str) -> None:
    """Adds the time of this indexing, per category that got articles, to the table at ``epochs``."""
    named = statused.where("status = 'indexed'").select(category_or_unknown(F.col("category")).alias("category")).distinct()
    named.withColumn("indexed_at", as_of).write.mode("append").parquet(epochs)


def read_epochs(spark: SparkSession, epochs: str) -> DataFrame:
    """(category, indexed_at): when articles of a category were last indexed."""
    marks = spark.read.schema("category string, indexed_at timestamp").parquet(epochs)
    return marks.groupBy("category").agg(F.max("indexed_at").alias("indexed_at"))


def statused_batch(articles: DataFrame, index: DataFrame) -> DataFrame:
    """One row per id with ``status``: ``indexed`` (to be), ``already_indexed``, ``no_title`` or ``invalid``.

    Of several articles with one id, one with a title comes first.
    """
    titled_first = F.when(has_text(F.col("title")), 0).otherwise(1)
    single = keep_one_per_key(articles, "id", [titled_first, F.col("title"), F.col("description"), F.col("category")])
    # Probed with the bare ids, so that the articles' other columns are computed once.
    known = matching_keys(index.select(F.col("news_id").alias("id")), articles, "id")
    flagged = single.join(known.withColumn("_known", F.lit(True)), "id", "left")
    status = (
        F.when(F.col("_known"), "already_indexed")
        .when(~has_text(F.col("title")), "no_title")
        .when(F.col("id").isNull() | (F.length("category") > MAX_CATEGORY_CHARS), "invalid")
        .otherwise("indexed")
    )
    return flagged.withColumn("status", status).drop("_known")


def embedding_rows(
    statused: DataFrame, as_of: Column, embedder: Embedder | None = None, status: str = "indexed"
) -> DataFrame:
    """Embedding-table rows for the articles to be indexed (or of another status)."""
    embedder = embedder or get_embedder()
    fresh = statused.where(F.col("status") == status).select(
        F.col("id").alias("news_id"),
        category_or_unknown(F.col("category")).alias("category"),
        "title",
        embedding_input(F.col("title"), F.col("description")).alias("_text"),
    )
    embedded = embedder.embed(fresh, "_text", "embedding")
    stamped = embedded.withColumn("created_at", as_of).withColumn("updated_at", as_of)
    return stamped.select(EMBEDDING.fieldNames())


def index_batch(
    articles: DataFrame,
    table: BatchTable,
    as_of: Column,
    embedder: Embedder | None = None,
    tag: str | None = None,
    quarantine: str | None = None,
    epochs: str | None = None,
    tally: Observation | None = None,
) -> DataFrame:
    """Append the new valid rows as one batch and return the statused articles.

    With an ``epochs`` path, the categories that got articles are dated there before
    the batch is appended, so that no list computed earlier is served after it. A
    ``tally`` observes the counts of :func:`newsloom.operators.stats.tally` while the
    rows are appended, without a pass of its own.

    Rows that break a constraint are not appended. They have the status
    ``invalid`` and, with a ``quarantine`` path, are added there as Parquet
    together with the names of the constraints. The statused articles are
    persisted, as each output reads them; the caller may unpersist them.
    """
    embedder = embedder or get_embedder()
    before = table.read()
    statused = statused_batch(articles, before).persist()
    if epochs is not None:
        mark_indexed(statused, as_of, epochs)
    watched = statused if tally is None else statused.observe(tally, *tally_counts())
    checked = with_violations(embedding_rows(watched, as_of, embedder), embedder.dim)
    table.append(valid_rows(checked), tag)
    if quarantine is not None:
        broken = with_violations(embedding_rows(statused, as_of, embedder, "invalid"), embedder.dim)
        quarantined_rows(broken).write.mode("append").parquet(quarantine)
    return statused
