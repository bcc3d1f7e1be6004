"""Helpers about how columns are evaluated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_evaluated(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Like ``withColumn``, for values too costly to compute twice.

    Spark moves a filter on a computed column below the projection that computes
    it, by repeating the computation inside the filter. It does not do so for the
    output of a generator, here one that yields exactly one row.
    """
    others = [F.col(c) for c in rows.columns if c != name]
    return rows.select(*others, F.explode(F.array(value)).alias(name))
