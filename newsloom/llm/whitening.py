"""Whitening of embeddings by polarisation.

Entries become integers, so every sum is exact. A first pass gives the number of
vectors and the sum of each dimension. A second takes the values less their mean,
rounded to an integer, and sums the squares of every dimension and of the sum of
every two dimensions. What the rounding leaves is put right in unbounded integers:
with y = x - c and R the sum of y, n^2 times a variance is n * sum y^2 - R^2.
The covariance of two dimensions is half of what the variance of their sum has
over their own variances. Its eigenvectors are found on the driver, which holds
the squares of all pairs: as many numbers as dimensions squared, whatever the rows.

Per task the second pass emits one row for each dimension, with its own square and
those of its sums with later dimensions; Spark adds them up by dimension and
place. A third pass measures the covariance of the whitened values themselves.

Rows take no part if their vector is null or has null or non-finite entries.
Vectors shorter than the longest count as ending in zeros. Where fewer directions
vary than components are asked for, the others' ``whitened`` and ``explained`` are
0 and they count in no error. Rows without an id, and repeated rows, count like
any other. An empty table gives an empty result. An exact deviation beyond 64 bits
fails the job instead of being cut.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import map_batches

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
ROWS_AT_ONCE = 1024
LARGEST = 2.0**61
WIDE = pa.decimal128(38, 0)
NO_VARIANCE = 1e-12  # of the trace: an eigenvalue below this times the dimensions is none


@dataclass(frozen=True)
class Whitening:
    n: int
    centre: np.ndarray  # integer, near each dimension's mean
    rest: np.ndarray  # exact sums of x - centre
    axes: np.ndarray  # components x dimensions
    values: np.ndarray  # eigenvalues; 0 where a direction does not vary
    trace: float

    @property
    def dim(self) -> int:
        return len(self.centre)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n; the integer part is taken off first."""
        return (x - self.centre) - self.rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        spread = np.sqrt(np.where(self.values > 0, self.values, np.inf))
        return self.centred(x) @ self.axes.T / spread

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - S)^2, exactly."""
        off = x - self.centre
        if self.n * (int(np.abs(off).max(initial=0)) + 1) < 1 << 62:
            return square_sums(self.n * off - self.rest).tolist()
        rest = self.rest.tolist()
        return [sum((self.n * v - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in off.tolist()]


def integers(column: pa.Array, dim: int, scale: int = SCALE, shift: int = SHIFT) -> np.ndarray:
    """floor(scale * c) + shift of a list column, rows x dim; what a shorter row lacks counts as 0."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    scaled = np.floor(scale * flat)
    if len(scaled) and np.abs(scaled).max() >= LARGEST:
        raise OverflowError("a scaled entry does not fit a long")
    out = np.full((len(column), dim), shift, np.int64)
    out[np.arange(dim)[None, :] < lengths[:, None]] = scaled.astype(np.int64) + shift
    return out


def square_sums(rows: np.ndarray) -> np.ndarray:
    """The exact sum of squares of each row, as Python integers."""
    reach = int(np.abs(rows).max(initial=0))
    if reach * reach * rows.shape[1] < 1 << 63:
        return np.einsum("ij,ij->i", rows, rows).astype(object)
    return np.array([sum(v * v for v in row) for row in rows.tolist()], object)


def usable(vector: str) -> Column:
    """Neither null nor with an entry that is null or not finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    return F.coalesce(F.forall(F.col(vector).cast("array<double>"), finite), F.lit(False))


def _vectors(rows: DataFrame, vector: str) -> DataFrame:
    return rows.where(usable(vector)).select(F.col(vector).cast("array<double>").alias("v"))


def _blocks(batches: Iterator[pa.RecordBatch], column: int, dim: int, scale: int, shift: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(start, ROWS_AT_ONCE)
            yield part, integers(part.column(column), dim, scale, shift)


def _summed(rows: DataFrame, make, kind: str) -> list:
    """The tasks' lists (row, sums) added up by row and position; dimensions squared of them reach the driver."""
    parts = map_batches(rows, make, f"row int, sums array<{kind}>").select("row", F.posexplode("sums").alias("at", "part"))
    return parts.groupBy("row", "at").agg(F.sum("part").alias("total")).collect()


def _row(number: int | range, lists: list, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(lists, pa.list_(kind))], ["row", "sums"])


def fit(rows: DataFrame, vector: str, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> Whitening | None:
    """Centre, axes and eigenvalues of all usable vectors; None if there is none with an entry."""
    given = _vectors(rows, vector)
    size = given.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    n, dim = size["n"], size["dim"] or 0
    if not n or not dim:
        return None

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim, object)
        for _, x in _blocks(batches, 0, dim, scale, shift):
            total += x.astype(object).sum(axis=0) if np.abs(x).max(initial=0) >= 1 << 52 else x.sum(axis=0).astype(object)
        yield _row([0], [total.tolist()], WIDE)

    whole = [0] * dim
    for r in _summed(given, sums, "decimal(38,0)"):
        whole[r["at"]] = int(r["total"])
    centre = np.array([(2 * s + n) // (2 * n) for s in whole], np.int64)
    rest = [s - n * int(c) for s, c in zip(whole, centre, strict=True)]

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pairs = np.zeros(dim, object), [np.zeros(dim - 1 - i, object) for i in range(dim)]
        for _, x in _blocks(batches, 0, dim, scale, shift):
            y = np.ascontiguousarray((x - centre).T)
            own += square_sums(y)
            for i in range(dim - 1):
                pairs[i] += square_sums(y[i + 1 :] + y[i])
        yield _row(range(dim), [[own[i], *pairs[i]] for i in range(dim)], WIDE)

    found = {(r["row"], r["row"] + r["at"]): int(r["total"]) for r in _summed(given, squares, "decimal(38,0)")}
    # n^2 times the variances, as integers.
    own = [n * found[i, i] - rest[i] ** 2 for i in range(dim)]
    matrix = np.empty((dim, dim))
    square = n * n
    for i in range(dim):
        matrix[i, i] = own[i] / square
        for j in range(i + 1, dim):
            both = n * found[i, j] - (rest[i] + rest[j]) ** 2
            matrix[i, j] = matrix[j, i] = (both - own[i] - own[j]) / (2 * square)
    trace = sum(own) / square
    values, vectors = np.linalg.eigh(matrix)
    kept = np.argsort(-values, kind="stable")[:components]
    values, axes = values[kept], vectors[:, kept].T
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]  # the same for all rows and runs
    values = np.where(values > NO_VARIANCE * dim * trace, values, 0.0)
    return Whitening(n, centre, np.array(rest, np.int64), axes, values, trace)


def identity_error(rows: DataFrame, vector: str, fitted: Whitening, scale: int = SCALE, shift: int = SHIFT) -> float:
    """The largest absolute entry of the whitened values' covariance less the identity, measured over all vectors."""
    k = len(fitted.values)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for _, x in _blocks(batches, 0, fitted.dim, scale, shift):
            w = fitted.whitened(x)
            first += w.sum(axis=0)
            second += w.T @ w
        yield _row(range(-1, k), [first, *second], pa.float64())

    sums = np.zeros((k + 1, k))
    for r in _summed(_vectors(rows, vector), moments, "double"):
        sums[r["row"] + 1, r["at"]] = r["total"]
    mean = sums[0] / fitted.n
    off = sums[1:] / fitted.n - np.outer(mean, mean) - np.eye(k)
    varies = fitted.values > 0
    return float(np.abs(off[varies][:, varies]).max(initial=0.0))


def whitened(
    rows: DataFrame, keys: dict[str, Column], vector: str, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT
) -> DataFrame:
    """Per usable row and component: the key columns, component, n, deviation, whitened, explained, identity_error."""
    names = list(keys)
    given = rows.where(usable(vector)).select(*[c.alias(n) for n, c in keys.items()], F.col(vector).cast("array<double>").alias("_vector"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    schema = f"{kept}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    fitted = fit(rows, vector, components, scale, shift)
    if fitted is None:
        # Without an entry there is no component, so no row either.
        return given.sparkSession.createDataFrame([], schema).withColumn("deviation", F.col("deviation").cast("long"))
    error = identity_error(rows, vector, fitted, scale, shift)
    k = len(fitted.values)
    share = fitted.values / fitted.trace if fitted.trace > 0 else np.zeros(k)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, len(names), fitted.dim, scale, shift):
            rows = len(x)
            each = pa.array(np.repeat(np.arange(rows), k))
            columns = [part.column(i).take(each) for i in range(len(names))]
            columns += [
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, fitted.n, np.int64)),
                pa.array(fitted.deviations(x), WIDE).take(each),
                pa.array(fitted.whitened(x).ravel()),
                pa.array(np.tile(share, rows)),
                pa.array(np.full(rows * k, error)),
            ]
            made = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
            yield pa.RecordBatch.from_arrays(columns, [*names, *made])

    return map_batches(given, project, schema).withColumn("deviation", F.col("deviation").cast("long"))
