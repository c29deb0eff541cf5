"""Vector tables: which rows are usable, and how a task sees them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def finite_vector(vector: str) -> Column:
    """Whether a vector is there and holds finite numbers only; an empty one does not count."""
    number = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    entries = F.col(vector).cast("array<double>")
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(entries, number)


def usual_length(df: DataFrame, vector: str) -> tuple[int, int]:
    """(length, rows) of the length that most vectors have, the greater length in a tie; zeros for an empty table."""
    counted = df.groupBy(F.size(vector).alias("_size")).agg(F.count(F.lit(1)).alias("_n"))
    most = counted.agg(F.max(F.struct("_n", "_size"))).first()[0]
    return (most["_size"], most["_n"]) if most else (0, 0)


def matrix(vectors: pa.Array, dtype: type = np.float64) -> np.ndarray:
    """Vectors of one length as rows."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(vectors), -1)


def blocks(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each batch with its column ``at`` as a matrix."""
    for batch in batches:
        if batch.num_rows:
            yield batch, matrix(batch.column(at))
