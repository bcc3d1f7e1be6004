"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.session import scratch_path, shared_dir, ship_package

BLANK_WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = rows.sparkSession
    path = scratch_path(spark, name)
    rows.write.parquet(path)
    table = spark.read.schema(rows.schema).parquet(path)
    table._written_at = path
    return table


def release(*tables: DataFrame) -> None:
    """Deletes tables made by :func:`written` once nothing will read them again."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._written_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def saved(rows: DataFrame) -> DataFrame:
    """An eager checkpoint in the shared folder, for small tables.

    Spark removes it once unused only where ``spark.cleaner.referenceTracking.cleanCheckpoints``
    is set; otherwise it stays in that folder.
    """
    shared_dir(rows.sparkSession)
    return rows.checkpoint(eager=True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def map_batches(
    rows: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow`` with this package available to the Python workers."""
    ship_package(rows.sparkSession)
    return rows.mapInArrow(function, schema)


def row_key(rows: DataFrame) -> Column:
    """128 bits of all columns of a row, nulls told apart: joins decisions to rows even where ids repeat."""
    cells = [F.col(f"`{c}`") for c in rows.columns]
    cells += [c.isNull() for c in cells]
    return F.struct(F.xxhash64(*cells).alias("a"), F.xxhash64(F.lit("b"), *cells).alias("b"))


def whole_rows(rows: DataFrame) -> DataFrame:
    """(key, row): each row as one struct under its :func:`row_key`, so that no name can clash."""
    return rows.select(row_key(rows).alias("key"), F.struct("*").alias("row"))
