"""Vector arithmetic on ``array<float>`` columns, for short pair lists.

Bulk scoring is in :mod:`newsloom.operators.similarity`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def l2_normalize(v: Column) -> Column:
    """Unit-length doubles; a zero vector stays zero."""

    def scaled(norm: Column) -> Column:
        by = F.when(norm == 0, F.lit(1.0)).otherwise(norm)
        return F.transform(v, lambda x: x.cast("double") / by)

    # The one-element array binds the norm, so that it is not computed per element.
    return F.transform(F.array(l2_norm(v)), scaled)[0]


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector is zero."""
    scale = l2_norm(a) * l2_norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)
