"""Mixing sources to target weights by systematic sampling.

A source's target share decides the expected copies of each of its documents:
target / source size, the same for all. Within a source the documents stand in
order of size (then id), their expected copies are summed up along that order, one
random offset is added, and a document is emitted once for every integer that the
sum crosses at it. So a document has its expected copies rounded down or up, and
each stretch of similar sizes gets its share, which keeps the words taken near the
target.

The order is a range partitioning, so a source of any size spreads over tasks;
positions are local numbers plus the counts of the ranges before. Only counts per
(source, range) meet in a window. Nothing is capped; the offset of a source comes
from a hash of its name and the seed, so reruns agree.

A null text has size 0. A null source is a source of its own, last in order.
Empty documents take no words. Rows repeated as a whole are sampled as separate
documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.llm.common import BLANK_WORD, row_key, saved, whole_rows, written

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
SEED = 20_240


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(BLANK_WORD)), F.lit(0)).cast("long")


def numbered(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Adds ``number``, the place from 1 of each row in its group by ``order``, and no task holds a group."""
    parts = written(
        rows.repartitionByRange(*[F.col(g).asc_nulls_last() for g in group], *order).withColumn(
            "_part", F.spark_partition_id()
        ),
        "ranges",
    )
    here = Window.partitionBy("_part", *group).orderBy(*order)
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        parts.groupBy("_part", *group)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.col("_part").alias("_at"), *[F.col(g).alias(f"_of_{g}") for g in group])
    )
    same = F.col("_part") == F.col("_at")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    local = parts.withColumn("_here", F.row_number().over(here))
    return local.join(counts, same).select(*rows.columns, (F.col("_here") + F.col("_before")).alias("number"))


def source_targets(sources: DataFrame) -> DataFrame:
    """source, source_size -> the same and target.

    Targets follow the weights until they reach ``MOST_COPIES`` times their
    source's size; the rest is shared again among the others. In the end a target
    is the lesser of that cap and weight * level; the level rises round by round,
    each an aggregate of two sums.
    """
    places = numbered(sources, [], [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(F.col("number") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    weighed = saved(places.select("source", "source_size", weight.alias("weight")))
    cap = F.col("source_size") * MOST_COPIES
    total, free = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (total or 0) / (free or 1)
    while True:
        above = cap < F.col("weight") * F.lit(level)
        full, free = weighed.agg(F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))).first()
        raised = (total - (full or 0)) / free if free else level
        if raised == level:
            break
        level = raised
    share = F.col("weight") * F.lit(float(level))
    target = F.when(cap < share, cap.cast("double")).otherwise(share)
    return weighed.select("source", "source_size", target.alias("target"))


def offset(source: Column) -> Column:
    """A number in [0, 1) from the source's name and the seed."""
    name = F.concat(F.lit(f"{SEED}:"), F.coalesce(source, F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def sampled(docs: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The key columns, source, size, source_size, target, copies of every row of ``docs``."""
    sized = written(
        docs.select(*[c.alias(n) for n, c in keys.items()], F.col("doc_id").alias("_id"), "source", n_words().alias("size")),
        "sizes",
    )
    sources = written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    targets = written(source_targets(sources), "targets").withColumnRenamed("source", "_source")
    places = numbered(sized, ["source"], [F.col("size").asc(), F.col("_id").asc()])
    rows = places.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "_id")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    shift = offset(F.col("source"))
    crossed = F.floor(ratio * F.col("number") + shift) - F.floor(ratio * (F.col("number") - 1) + shift)
    return rows.withColumn("copies", crossed.cast("long")).drop("number")


def mixed_sizes(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken (and source, copies)."""
    rows = sampled(docs, {"doc_id": F.col("doc_id")})
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is emitted, with all its columns."""
    decided = (
        sampled(docs, {"_row": row_key(docs)}).groupBy("_row").agg(F.sum("copies").cast("int").alias("_copies")).where("_copies > 0")
    )
    rows = whole_rows(docs).dropDuplicates(["key"]).join(decided, F.col("key") == F.col("_row"))
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("copy")).select("row.*")
