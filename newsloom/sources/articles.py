"""Scans of the article table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.schemas import ARTICLE, DEFAULT_PAGE_SIZE, MAX_PAGE_SIZE

CORRUPT = "_corrupt_record"
LIST_FIELDS = ["id", "title", "description", "category", "publisher_id"]


def read_articles(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Articles from any Spark source (parquet, json, orc, jdbc, ...), never with inferred types."""
    reader = spark.read.format(fmt).options(**options)
    if fmt == "jdbc":
        return reader.load().select([F.col(f.name).cast(f.dataType).alias(f.name) for f in ARTICLE])
    return reader.schema(ARTICLE).load(path)


def read_checked(
    spark: SparkSession, path: str, fmt: str = "json", **options: str
) -> tuple[DataFrame, DataFrame]:
    """Text files of articles as (articles, quarantine).

    Records that do not parse, or hold a value of another type than the column's,
    go to the quarantine (file, record) with their text; they stop no job and no
    part of them counts as an article. JSON and CSV only: others have no records to break.
    """
    if fmt not in ("json", "csv"):
        raise ValueError("only json and csv have a permissive mode, not %s" % fmt)
    schema = T.StructType([*ARTICLE.fields, T.StructField(CORRUPT, T.StringType())])
    reader = spark.read.format(fmt).options(**options).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    # Spark skips the parsing of columns that a query does not read, and with it their check; so read all.
    every = F.pmod(F.xxhash64(*ARTICLE.names), F.lit(2)) >= 0
    parsed = reader.schema(schema).load(path).withColumn("file", F.input_file_name()).where(every)
    broken = parsed.where(F.col(CORRUPT).isNotNull()).select("file", F.col(CORRUPT).alias("record"))
    return parsed.where(F.col(CORRUPT).isNull()).select(ARTICLE.names), broken


def list_articles(articles: DataFrame, category: str | None = None) -> DataFrame:
    """The lightweight list, without the content column."""
    rows = articles if not category else articles.where(F.col("category") == category)
    return rows.select(LIST_FIELDS)


def dealt(scan: DataFrame) -> DataFrame:
    """A scan that comes in fewer pieces than there are cores, dealt out to all; any other stays where it is.

    For work done row by row on a few large files. Give it scans only: an input
    with a shuffle would be run to learn its pieces.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def page_of(rows: DataFrame, page: int = 0, size: int = DEFAULT_PAGE_SIZE, key: str = "id") -> DataFrame:
    """Rows ``[page * size, (page + 1) * size)`` in key order, null keys first.

    Spark answers ``orderBy.offset.limit`` by keeping offset + limit rows in one
    task. So the key range that holds the page is located first, from the counts
    and bounds of a range partitioning (one row per partition reaches the driver);
    only that range is sorted, and its filter reaches the scan.
    """
    if page < 0 or not 1 <= size <= MAX_PAGE_SIZE:
        raise ValueError("page must be >= 0 and size between 1 and %d" % MAX_PAGE_SIZE)
    first, last, k = page * size, (page + 1) * size, F.col(key)
    parts = (
        rows.select(k)
        .repartitionByRange(k)
        .groupBy(F.spark_partition_id().alias("part"))
        .agg(F.count(k).alias("n"), F.count_if(k.isNull()).alias("nulls"), F.min(k).alias("low"), F.max(k).alias("high"))
        .orderBy("part")
        .collect()
    )
    nulls = before = sum(p["nulls"] for p in parts)
    skipped, held = nulls, []
    for p in parts:
        if p["n"] and before < last and before + p["n"] > first:
            skipped = skipped if held else before
            held.append(p)
        before += p["n"]
    within = k.between(held[0]["low"], held[-1]["high"]) if held else F.lit(False)
    if first < nulls:
        within, skipped = within | k.isNull(), 0
    return rows.where(within).orderBy(key).offset(first - skipped if first >= skipped else 0).limit(size)


def fetch_fields(requests: DataFrame, articles: DataFrame, fields: list[str]) -> DataFrame:
    """Named fields by id, one row per request; an unknown id gets the status ``not_found``."""
    wanted = articles.select(F.col("id").alias("news_id"), F.lit(True).alias("_known"), *fields)
    return (
        requests.join(wanted, "news_id", "left")
        .withColumn("status", F.when(F.col("_known"), "ok").otherwise("not_found"))
        .drop("_known")
    )


def with_existence(requests: DataFrame, table: DataFrame, key: str = "news_id", flag: str = "present") -> DataFrame:
    """Requests with a flag telling whether the key is in the table."""
    known = matching_keys(table, requests, key).withColumn(flag, F.lit(True))
    return requests.join(known, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def matching_keys(table: DataFrame, batch: DataFrame, key: str = "news_id") -> DataFrame:
    """The batch's keys that the table holds.

    Written as a semi join of the table against the batch: when the batch is
    small Spark broadcasts it and the table's keys are not shuffled.
    """
    return table.select(key).join(batch.select(key), key, "left_semi").distinct()
