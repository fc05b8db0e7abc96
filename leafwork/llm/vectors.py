"""Embedding columns: which rows hold a usable vector, and numpy views of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: A vector that is not null or empty, without null, NaN or infinite components, and not zero.
USABLE = "embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0)"


def usable() -> Column:
    return F.expr(f"coalesce({USABLE}, false)")


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls, all of one length, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def main_dimension(rows: DataFrame) -> int:
    """The commonest length of the vectors (the smaller at a tie); 0 without rows."""
    found = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return found["d"] if found else 0


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products, summed up component by component, so that equal rows have equal results anywhere."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out
