"""A Parquet table made of committed batch directories.

Plain Parquet appends are not atomic, so each write goes to its own directory
and counts only once the job's ``_SUCCESS`` marker is there. ``append`` writes
just the new rows. ``replace`` and ``compact`` write a batch that names the
batches it stands for and hides these only, so a batch that another writer
commits in the meantime stays visible. Nothing that is being read is ever
overwritten.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_NAME = re.compile(r"^batch=[0-9a-f]{32}-(base|delta)(?:-(.+))?$")


class BatchTable:
    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        partition_by: str | None = None,
    ):
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = schema
        self.partition_by = partition_by

    def _done(self) -> list[re.Match]:
        """The names of all batches whose job has committed, by one listing."""
        jvm = self.spark._jvm
        literal = re.sub(r"([\\{}\[\]*?])", r"\\\1", self.path)
        markers = jvm.org.apache.hadoop.fs.Path(f"{literal}/batch=*/_SUCCESS")
        fs = markers.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        names = (status.getPath().getParent().getName() for status in fs.globStatus(markers) or [])
        return [match for match in map(_NAME.match, sorted(names)) if match]

    def committed(self) -> list[str]:
        """Directories that make up the current state."""
        done = self._done()
        bases = [self._folds(m[0]) for m in done if m[1] == "base"]
        hidden = {r.value for r in self.spark.read.text(bases).collect()} if bases else set()
        return [f"{self.path}/{m[0]}" for m in done if m[0] not in hidden]

    def has_batch(self, tag: str) -> bool:
        return any(m[2] == tag for m in self._done())

    def read(self, folders: list[str] | None = None) -> DataFrame:
        """The current state, or that of the given :meth:`committed` directories."""
        folders = self.committed() if folders is None else folders
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        # The directories look like partitions of one table, which lets them be read together.
        rows = self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*folders)
        return rows.select(self.schema.fieldNames())

    def append(self, rows: DataFrame, tag: str | None = None) -> bool:
        """Add a batch; false if a batch with this tag is already there."""
        if tag is not None and self.has_batch(tag):
            return False
        self._write(rows, self._name("delta", tag))
        return True

    def replace(self, rows: DataFrame, folders: list[str] | None = None) -> None:
        """Publish the rows in place of the given :meth:`committed` directories, or of all.

        Rows made from this table should name the directories they were read from.
        """
        name = self._name("base", None)
        folded = [(f.rsplit("/", 1)[-1],) for f in (self.committed() if folders is None else folders)]
        # Written first: it counts from the moment that the batch itself does.
        self.spark.createDataFrame(folded, "value string").coalesce(1).write.text(self._folds(name))
        self._write(rows, name)

    def compact(self) -> None:
        """Fold all batches into one; tags of folded batches stay known."""
        folders = self.committed()
        self.replace(self.read(folders), folders)

    def _write(self, rows: DataFrame, name: str) -> None:
        rows = rows.select(self.schema.fieldNames())
        if self.partition_by:
            # Rebalancing keeps the file count low and still splits a hot partition value.
            rows = rows.hint("rebalance", self.partition_by)
        writer = rows.write.mode("errorifexists")
        if self.partition_by:
            writer = writer.partitionBy(self.partition_by)
        writer.parquet(f"{self.path}/{name}")

    def _folds(self, name: str) -> str:
        return f"{self.path}/_folds/{name}"

    @staticmethod
    def _name(kind: str, tag: str | None) -> str:
        return f"batch={uuid.uuid4().hex}-{kind}" + (f"-{tag}" if tag is not None else "")
