"""Vectors in Spark's arrays as numpy matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def is_vector(column: Column) -> Column:
    """Neither null nor empty, and no entry null, NaN or infinite."""
    number = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(column) > 0) & number, F.lit(False))


def matrices(batches: Iterator[pa.RecordBatch], column: str, numbers: int = 1 << 18) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of like length, and their vectors as the rows of a matrix of doubles; at most about `numbers` entries at a time."""
    for batch in batches:
        lists = batch.column(column)
        offs = lists.offsets.to_numpy()
        values = lists.values.to_numpy(zero_copy_only=False).astype(float)
        size = np.diff(offs)
        for d in np.unique(size).tolist():
            at = np.flatnonzero(size == d)
            step = max(1, numbers // max(d, 1))
            for k in range(0, len(at), step):
                rows = at[k : k + step]
                yield batch.take(pa.array(rows)), values[offs[rows][:, None] + np.arange(d)]
