"""Which rows of an embedding table take part, and their arrays in Python."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str = "embedding") -> Column:
    """Not null, with finite components only and not all zero."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def by_length(vectors: DataFrame, column: str = "embedding") -> list[DataFrame]:
    """The usable rows, a frame for each length of vector: vectors of different lengths have no cosine. Lengths are few, whatever the number of rows."""
    rows = vectors.where(usable(column) & F.col("vec_id").isNotNull())
    lengths = sorted(r["d"] for r in rows.select(F.size(column).alias("d")).distinct().collect())
    return [rows.where(F.size(column) == d) for d in lengths] if len(lengths) > 1 else [rows] * len(lengths)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x
