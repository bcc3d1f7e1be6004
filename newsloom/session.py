"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", memory: str = "8g", name: str = "newsloom") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the one you are given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a local
    master may fall back to a temporary folder, because there the driver's disk
    is the executors' disk.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="newsloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under :func:`shared_dir`."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Spark's own setting: the shuffle files of a query are removed when it has ended, not when the driver collects its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: as a checkpoint, but compressed and by columns.

    The table is all that stays on disk; the shuffle files that made it are removed.
    """
    spark = rows.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        rows.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(rows.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application.

    With ``--py-files`` it already is; then this adds the same files again, harmlessly.
    """
    sc = spark.sparkContext
    if getattr(sc, "_newsloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="newsloom-ship-")) / "newsloom.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, str(source.relative_to(package.parent)))
    sc.addPyFile(str(archive))
    sc._newsloom_shipped = True


# Rows of an Arrow batch where rows are whole documents; Spark's own number is ten times that.
DOCUMENTS_PER_BATCH = 1000


def bound_batches(spark: SparkSession) -> None:
    """Let Python workers get whole documents in batches that stay small; a number the user chose is kept.

    A batch, and what is made of it, is in memory at once, several times over, in every
    worker; Spark bounds batches by rows alone.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(DOCUMENTS_PER_BATCH))
