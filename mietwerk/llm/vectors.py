"""Reading vector columns of Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str, dimension: int) -> Column:
    """Whether a vector has `dimension` finite components, none null, and isn't zero."""
    v = F.col(column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) == dimension) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def dimension(df: DataFrame, column: str = "embedding") -> int:
    """Components of most vectors; the smaller number on a tie, 0 without any."""
    found = df.where(F.col(column).isNotNull()).groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return found["d"] if found else 0


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column whose vectors are all usable."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that tiny or huge rows don't under- or overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))
