"""Embedding whitening by shifted CholeskyQR (Fukaya et al. 2020).

The rows, centred, form a tall matrix A.  One *Gram pass* adds up Q'Q over all
rows in their tasks, where Q is A divided from the right by the triangles found
so far (triangular solves, one after the other); the Cholesky factor of the sum,
shifted by a little more than its rounding errors in the first pass and by
machine precision later, is the next triangle.  Passes go on until Q'Q is a
projection, the identity if the rows have full rank; three mostly do.  The
product of the triangles is R of A = Q R, and the singular values and right
vectors of this small R give eigenvalues and eigenvectors of the covariance
without ever squaring its condition number.

Entries are put on a grid of whole numbers first: x = floor(scale * c) + offset.
Sums of x are exact, and so is n * x - S, the centred row times n, so centring
loses nothing however large the offset is.  Grid numbers saturate at 2^62.

A task sends one row per dimension with its partial sums, which Spark adds; the
driver holds matrices of dimensions x dimensions only.

Rows take part if their vector is there, holds finite numbers only and has the
length that most vectors have.  Repeated rows count as often as they occur and
are returned each; null ids are kept.  A direction whose standard deviation is
below 1e-10 of the greatest is no component: constant dimensions or fewer rows
than dimensions give fewer components, and no spread, one row or an empty table
give none, so no rows are returned.  ``deviation`` is null where it leaves the
range of a long.  Further columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tasteforge.llm.vectors import blocks, finite_vector, usual_length

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
LARGEST = float(2**62)
HALF = 1 << 31
MAX_PASSES = 8
# Share of the greatest deviation below which rounding errors of the rows leave nothing to whiten.
LEAST_DEVIATION = 1e-10
PRECISION = float(np.finfo(np.float64).eps)
WHITENED = "n long, deviation long, component int, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """A fit: everything needed to whiten further rows, no larger than dimensions x dimensions."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray  # dimensions x rank, unit columns by falling eigenvalue
    eigenvalues: np.ndarray
    explained: np.ndarray
    passes: int
    scale: float
    offset: int

    def project(self, centred: np.ndarray, most: int) -> np.ndarray:
        return centred @ (self.components[:, :most] / np.sqrt(self.eigenvalues[:most]))


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part, entries as double."""
    chosen = vectors.filter(finite_vector(vector)).select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    return chosen.filter(F.size("vector") == usual_length(chosen, "vector")[0])


def grid(entries: np.ndarray, scale: float, offset: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(entries * scale), -LARGEST, LARGEST).astype(np.int64) + offset


def centred_times_n(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - S, exact: as 64-bit numbers where they fit, else as Python's."""
    largest = max(int(x.max(initial=0)), -int(x.min(initial=0)), 1)
    if 2 * largest * n < 2**62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    return (centred_times_n(x, n, sums) / n).astype(np.float64)


def solve_right(rows: np.ndarray, triangle: np.ndarray) -> np.ndarray:
    """rows / triangle, for an upper triangle: one column after the other."""
    solved = np.empty_like(rows, order="F")
    for j in range(triangle.shape[0]):
        solved[:, j] = (rows[:, j] - solved[:, :j] @ triangle[:j, j]) / triangle[j, j]
    return solved


def exact_sums(chosen: DataFrame, scale: float, offset: int) -> tuple[int, tuple[int, ...]]:
    """(n, sums of x by dimension).  Upper and lower halves of x are summed apart, so that no sum overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, 0, 0
        for _, entries in blocks(batches, 1):
            x = grid(entries, scale, offset)
            n, high, low = n + len(x), high + (x // HALF).sum(axis=0), low + (x % HALF).sum(axis=0)
        if n:
            at = pa.array(np.arange(len(high)), pa.int32())
            yield pa.RecordBatch.from_arrays([at, pa.array(np.full(len(high), n)), pa.array(high), pa.array(low)], ["at", "n", "high", "low"])

    parts = chosen.mapInArrow(run, "at int, n long, high long, low long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    # One row for each dimension.
    rows = parts.groupBy("at").agg(F.sum("n").alias("n"), wide("high"), wide("low")).orderBy("at").collect()
    return (rows[0]["n"] if rows else 0), tuple(int(r["high"]) * HALF + int(r["low"]) for r in rows)


def gram(chosen: DataFrame, rows_of, width: int) -> np.ndarray:
    """Sum of Q'Q over all rows; ``rows_of`` makes Q's rows of the table's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for _, entries in blocks(batches, 1):
            q = rows_of(entries)
            total += q.T @ q
        row, column = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(row * width + column), pa.array(total[row, column])], ["at", "value"])

    summed = np.zeros(width * width)
    # Half a matrix of dimensions x dimensions.
    for at, value in chosen.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value")).collect():
        summed[at] = value
    upper = summed.reshape(width, width)
    return upper + np.triu(upper, 1).T


def fit_whitening(chosen: DataFrame, scale: float = SCALE, offset: int = OFFSET) -> Whitening:
    """Fit on all rows of ``usable``."""
    n, sums = exact_sums(chosen, scale, offset)
    width = len(sums)
    nothing = Whitening(n, sums, np.empty((width, 0)), np.empty(0), np.empty(0), 0, scale, offset)
    if n == 0:
        return nothing
    triangles: list[np.ndarray] = []
    product = np.eye(width)
    for passed in range(MAX_PASSES + 1):
        rows_of = lambda entries: _orthogonalised(centred(grid(entries, scale, offset), n, sums), triangles)
        found = gram(chosen, rows_of, width)
        norm = np.linalg.norm(found, 2)
        if norm == 0:
            return nothing
        if passed and np.abs(found @ found - found).max() <= 100 * width * PRECISION:
            break
        # Later passes are shifted too: rows of lower rank keep their sum singular.
        shift = 11 * (n * width + width * (width + 1)) * PRECISION * norm if not passed else 10 * width * PRECISION * norm
        triangle = _triangle(found, min(shift, norm))
        product = triangle @ product
        triangles.append(triangle)
    # Q'Q is a projection by now, the identity at full rank: directions without any row drop out of R.
    _, singular, right = np.linalg.svd(found @ product)
    eigenvalues = singular**2 / n
    rank = int((singular > singular[0] * LEAST_DEVIATION).sum())
    return Whitening(n, sums, right[:rank].T.copy(), eigenvalues[:rank], eigenvalues[:rank] / eigenvalues.sum(), len(triangles), scale, offset)


def _orthogonalised(rows: np.ndarray, triangles: list[np.ndarray]) -> np.ndarray:
    for triangle in triangles:
        rows = solve_right(rows, triangle)
    return rows


def _triangle(gram_sum: np.ndarray, shift: float) -> np.ndarray:
    """Upper Cholesky factor of the sum and a shift, which grows while rounding errors leave the sum indefinite."""
    while True:
        try:
            return np.linalg.cholesky(gram_sum + shift * np.eye(len(gram_sum))).T
        except np.linalg.LinAlgError:
            shift *= 10


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: float = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, n, deviation, component, whitened, explained, identity_error): a row for each usable vector and component."""
    chosen = usable(vectors, vec_id, vector)
    fitted = fit_whitening(chosen, scale, offset)
    most = min(components, len(fitted.eigenvalues))
    error = 0.0
    if most:
        project = lambda entries: fitted.project(centred(grid(entries, scale, offset), fitted.n, fitted.sums), most)
        error = float(np.abs(gram(chosen, project, most) / fitted.n - np.eye(most)).max())
    return apply_whitening(chosen, fitted, most, error)


def apply_whitening(chosen: DataFrame, fitted: Whitening, most: int, error: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, entries in blocks(batches, 1):
            if not most:
                continue
            exact = centred_times_n(grid(entries, fitted.scale, fitted.offset), fitted.n, fitted.sums)
            whitened = fitted.project((exact / fitted.n).astype(np.float64), most)
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(rows), most))),
                    pa.array(np.full(rows * most, fitted.n, np.int64)),
                    pa.array(_squares(exact), pa.int64()).take(pa.array(np.repeat(np.arange(rows), most))),
                    pa.array(np.tile(np.arange(1, most + 1, dtype=np.int32), rows)),
                    pa.array(whitened.ravel()),
                    pa.array(np.tile(fitted.explained[:most], rows)),
                    pa.array(np.full(rows * most, error)),
                ],
                ["vec_id", *[c.split()[0] for c in WHITENED.split(", ")]],
            )

    return chosen.mapInArrow(run, f"vec_id {chosen.schema['vec_id'].dataType.simpleString()}, {WHITENED}")


def _squares(exact: np.ndarray) -> list[int | None] | np.ndarray:
    """Row sums of squares as long, None beyond it."""
    largest = max(int(exact.max(initial=0)), -int(exact.min(initial=0)))
    if largest * largest * exact.shape[1] < 2**63:
        return (exact.astype(np.int64) ** 2).sum(axis=1)
    totals = [sum(int(v) ** 2 for v in row) for row in exact]
    return [t if t < 2**63 else None for t in totals]
