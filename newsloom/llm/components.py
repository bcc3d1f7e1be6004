"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node tells its larger (or its smaller) neighbours about the least node it knows.

    ``edges`` has pairs a > b. A node's neighbours are never gathered in one row:
    minima are combined map-side and joined back.
    """
    if large:
        links = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
    else:
        links = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = links.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("root"))
    told = links.join(least, "u")
    if large:
        told = told.where("v > u").select(F.col("v").alias("a"), F.col("root").alias("b"))
    else:
        told = told.where("v != root").select(F.col("v").alias("a"), F.col("root").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("root").alias("b"))
        )
    return told.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); the component is its least node.

    Rounds grow with the logarithm of the longest path; each is cut off by a
    checkpoint in the shared folder.
    """
    edges = saved(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    )
    before = None
    while True:
        edges = saved(_star(_star(edges, large=True), large=False))
        sums = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sums == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = sums
