"""Embedding whitening by shifted CholeskyQR.

The centred rows A are never put together.  Each pass over the table sends on one Gram matrix a task: the first pass that of
A, whose Cholesky factor (after a small shift, so that it exists for any rank) is R1; the next ones that of A R1^-1, then of
A R1^-1 R2^-1, made row by row by triangular solves.  After three such passes the rows are orthonormal to rounding, the
product R = R3 R2 R1 is the triangular factor of A, and the singular value decomposition of that small matrix gives the
components and their variances without squaring the condition number, which an eigendecomposition of the covariance would.
A last pass measures the covariance of the whitened rows; if that is not the identity to IDENTITY, the rows are
orthogonalised once more.

Grams are summed in two steps, by groups of tasks and then over the groups, streaming, so no process holds more than a few
matrices of size d x d, and the driver gets one.

* Vectors that are null or hold null or non-finite entries are dropped; shorter ones count as filled up with 0; an entry's
  ``floor(64 * c)`` is held to +-2**40.  Rows with a null id stay, rows that are repeated count as often as they are there.
* An empty table, and one without any entry, gives no rows.  Fewer components than asked for are returned where there are
  fewer with a variance above RANK of the greatest: constant or linearly dependent dimensions have none.
* Equal variances: the components span the same space, any basis of it may come out.
* Columns of other names are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernal.llm import vectors
from quernal.llm.text import table

COMPONENTS = 32
SCALE, OFFSET, LIMIT = 64, 1_000_000, float(1 << 40)
#: Passes that orthogonalise: at least, at most; and how near to the identity the whitened covariance has to come.
PASSES, MOST_PASSES, IDENTITY = 3, 6, 1e-9
#: The shift as a share of the Gram's trace, and the least variance of a component as a share of the greatest.
SHIFT, RANK = 1e-13, 1e-20
ROWS = 4096
_GROUPS = 32


def scaled(batch: pa.RecordBatch, size: int) -> np.ndarray:
    """x of each entry, as whole numbers."""
    return np.floor(np.clip(SCALE * vectors.dense(batch.column("v"), size), -LIMIT, LIMIT)).astype(np.int64) + OFFSET


class Centre(NamedTuple):
    """n rows and their exact sums; ``whole`` is the mean rounded, so that x - whole is small and exact."""

    n: int
    size: int
    sums: np.ndarray

    @property
    def whole(self) -> np.ndarray:
        return self.sums // self.n

    def rows(self, batch: pa.RecordBatch) -> np.ndarray:
        """x - S/n, rounded once."""
        return (scaled(batch, self.size) - self.whole) - (self.sums - self.n * self.whole) / self.n

    def deviations(self, batch: pa.RecordBatch) -> list[int]:
        """sum of (n*x - S)**2, exact: in 64 bits where it fits, else in Python's integers."""
        off = scaled(batch, self.size) - self.whole
        rest = self.sums - self.n * self.whole
        most = self.n * (int(np.abs(off).max(initial=0)) + 1)
        if most * most * max(self.size, 1) < 1 << 63:
            return np.square(self.n * off - rest).sum(axis=1).tolist()
        exact = self.n * off.astype(object) - rest.astype(object)
        return (exact * exact).sum(axis=1).tolist()


class Whitening(NamedTuple):
    """What a table's rows become: axes (a column for each component), their variances, the total variance."""

    centre: Centre
    axes: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float

    def project(self, rows: np.ndarray) -> np.ndarray:
        return (rows @ self.axes) / np.sqrt(self.variances)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, len(batch), ROWS):
            yield batch.slice(start, ROWS)


def _total(rows: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray], kind: type) -> np.ndarray:
    """The sum over all slices of what ``of`` makes of one: once in each task, then in each group of tasks, then once."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in _slices(batches):
            one = of(part)
            total = one if total is None else total + one
        if total is not None:
            group = TaskContext.get().partitionId() % _GROUPS
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([total.astype(kind).tobytes()], pa.binary())], names=["g", "total"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for cell in batch.column("total"):
                one = np.frombuffer(cell.as_buffer(), kind)
                total = one.copy() if total is None else total + one
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["g", "total"])

    schema = "g int, total binary"
    sums = rows.mapInArrow(partial, schema).groupBy("g").applyInArrow(merged, schema)  # at most _GROUPS rows, all of g = 0
    return np.frombuffer(sums.groupBy("g").applyInArrow(merged, schema).first().total, kind)


def _solved(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """rows @ factor^-1 for an upper triangular factor, by forward substitution over its columns."""
    out = np.empty_like(rows)
    for j in range(factor.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def _factor(gram: np.ndarray, shifted: bool) -> np.ndarray:
    """Upper triangular R with R'R = gram; shifted, or where there is none without a shift, of gram + shift * I."""
    eye = np.eye(len(gram)) * SHIFT * (np.trace(gram) or 1.0)
    for shift in ((0.0, 1.0, 1e3, 1e6) if not shifted else (1.0, 1e3, 1e6)):
        try:
            return np.linalg.cholesky(gram + shift * eye).T
        except np.linalg.LinAlgError:
            continue
    raise ArithmeticError("the Gram matrix has no Cholesky factor")


def usable(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v) of the rows that take part."""
    return rows.select(F.col(id_column).alias("id"), F.col(vector).alias("v")).where(vectors.finite(F.col("v")))


def fit(kept: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of rows (id, v); None for none."""
    n, size = kept.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n or not size:
        return None
    slim = kept.select("v")
    centre = Centre(n, size, _total(slim, lambda part: scaled(part, size).sum(axis=0), np.int64))
    factors: list[np.ndarray] = []
    best, total = None, 0.0
    for done in range(MOST_PASSES):

        def gram(part: pa.RecordBatch, known: tuple[np.ndarray, ...] = tuple(factors)) -> np.ndarray:
            rows = centre.rows(part)
            for factor in known:
                rows = _solved(rows, factor)
            return rows.T @ rows

        found = _total(slim, gram, np.float64).reshape(size, size)
        total = total or float(np.trace(found)) / n  # of the first pass: the variance before any shift
        if not total:
            return Whitening(centre, np.zeros((size, 0)), np.zeros(0), 0.0, 0.0)
        factors.append(_factor(found, shifted=done == 0))
        if done + 1 < PASSES:
            continue
        whole = factors[0]
        for factor in factors[1:]:
            whole = factor @ whole
        _, singular, axes = np.linalg.svd(whole)
        variances = singular**2 / n
        k = min(components, int((variances > RANK * variances[0]).sum()))
        best = Whitening(centre, axes[:k].T.copy(), variances[:k], total, 0.0)

        def whitened_gram(part: pa.RecordBatch, found: Whitening = best) -> np.ndarray:
            white = found.project(centre.rows(part))
            return np.vstack([white.T @ white, white.sum(axis=0)])

        moments = _total(slim, whitened_gram, np.float64).reshape(k + 1, k) / n
        covariance = moments[:k] - np.outer(moments[k], moments[k])
        best = best._replace(identity_error=float(np.abs(covariance - np.eye(k)).max()))
        if best.identity_error <= IDENTITY:
            break
    return best


SCHEMA = "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"


def transform(kept: DataFrame, found: Whitening) -> DataFrame:
    """One row for each row (id, v) and component, as :data:`SCHEMA` says."""
    whole = pa.decimal128(38, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            white = found.project(found.centre.rows(part))
            deviations = pa.array([str(x) for x in found.centre.deviations(part)], pa.string()).cast(whole)
            yield pa.RecordBatch.from_arrays([part.column("id"), deviations, pa.array(list(white), pa.list_(pa.float64()))], names=["id", "deviation", "white"])

    rows = kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, deviation decimal(38,0), white array<double>")
    share = F.array(*[F.lit(float(e / found.trace)) for e in found.variances])
    rows = rows.select(F.col("id").alias("vec_id"), "deviation", F.posexplode("white").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(found.centre.n).cast("bigint").alias("n"), "deviation", "whitened",
        share[F.col("at")].alias("explained"), F.lit(found.identity_error).alias("identity_error"),
    )


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """rows (vec_id, embedding) -> their whitened coordinates; see the module."""
    kept = usable(rows)
    found = fit(kept, components)
    if found is None or not len(found.variances):
        return rows.sparkSession.createDataFrame([], SCHEMA)
    return transform(kept, found)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns; a deviation beyond 64 bits is an error, never a wrong number."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("bigint"))
