"""A keyed Parquet table in hash buckets, of which an upsert or delete rewrites only the touched ones.

Rows lie in one directory per ``pmod(xxhash64(key), n_buckets)``. A change reads the
buckets of its keys (the directory name prunes the scan), writes their new contents
to the shared working folder and then puts them in place by dynamic partition
overwrite; buckets that end up empty are removed. Each bucket is replaced whole. A
publication that failed half-way can be repeated, as upserts and deletes by key give
the same again. Which buckets are touched is a list of at most ``n_buckets`` numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.operators.merge import delete_keys, upsert
from newsloom.session import scratch_path

BUCKET = "bucket"


class BucketTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str = "news_id", n_buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.n_buckets = spark, path.rstrip("/"), schema, key, n_buckets

    def bucket_of(self, key: str | None = None) -> Column:
        return F.pmod(F.xxhash64(key or self.key), F.lit(self.n_buckets)).cast("int")

    def create(self, rows: DataFrame) -> None:
        """The table's first contents; fails where there is a table already."""
        self._placed(rows).write.mode("errorifexists").partitionBy(BUCKET).parquet(self.path)

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The whole table, or the given buckets of it."""
        stored = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        rows = self.spark.read.schema(stored).parquet(self.path)
        if buckets is not None:
            rows = rows.where(F.col(BUCKET).isin(buckets)) if buckets else rows.limit(0)
        return rows.select(self.schema.fieldNames())

    def upsert(self, updates: DataFrame, as_of: Column, order: str | None = None) -> list[int]:
        """Applies :func:`newsloom.operators.merge.upsert`; returns the buckets rewritten."""
        return self._publish(updates, lambda old: upsert(old, updates, as_of, self.key, order))

    def delete(self, keys: DataFrame) -> list[int]:
        """Removes the rows of the given keys; returns the buckets rewritten, those that hold one of them."""
        held = self.read().select(self.key).join(keys.select(self.key), self.key, "left_semi")
        return self._publish(held, lambda old: delete_keys(old, keys, self.key))

    def _publish(self, keyed: DataFrame, change: Callable[[DataFrame], DataFrame]) -> list[int]:
        touched = sorted(r[0] for r in keyed.select(self.bucket_of()).distinct().collect())
        if not touched:
            return touched
        made = scratch_path(self.spark, "buckets")
        self._placed(change(self.read(touched))).write.partitionBy(BUCKET).parquet(made)
        stored = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        new = self.spark.read.schema(stored).parquet(made)
        filled = {r[0] for r in new.select(BUCKET).distinct().collect()}
        # Rebalanced again, as the files read may have been cut anywhere.
        placed = new.hint("rebalance", BUCKET)
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        paths = self.spark._jvm.org.apache.hadoop.fs.Path
        files = paths(self.path).getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        for bucket in touched:
            if bucket not in filled:
                files.delete(paths(f"{self.path}/{BUCKET}={bucket}"), True)
        return touched

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.schema.fieldNames(), self.bucket_of().alias(BUCKET)).hint("rebalance", BUCKET)
