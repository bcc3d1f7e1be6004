"""Summary methods side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators import centrality as C
from newsloom.plans.summaries import summarize_split
from newsloom.schemas import COMPARE_RATIO


def compare_methods(docs: DataFrame, methods: list[str], ratio: float = COMPARE_RATIO) -> DataFrame:
    """(method, n_docs, avg_summary_chars, avg_compression), compression being summary over text length.

    The built-in methods share one exchange, below which the texts are split once.
    """
    split = C.split_documents(docs)
    lengths = docs.select("doc_id", F.length("text").alias("text_chars"))

    def made(method: str) -> DataFrame:
        summary = summarize_split(method, docs, split, ratio)
        return summary.select("doc_id", F.lit(method).alias("method"), F.length("summary").alias("chars"))

    every = reduce(DataFrame.unionByName, [made(m) for m in methods]).join(lengths, "doc_id")
    share = F.when(F.col("text_chars") > 0, F.col("chars") / F.col("text_chars"))
    return every.groupBy("method").agg(
        F.count("*").alias("n_docs"),
        F.avg("chars").alias("avg_summary_chars"),
        F.avg(share).alias("avg_compression"),
    )
