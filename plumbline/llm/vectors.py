"""Columns of vectors as matrices of NumPy, and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each row is a vector of ``dim`` finite components, and those that are, as doubles in their order.

    Null vectors, other lengths, null and non-finite components aren't.
    """
    right = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    values = column.filter(right).flatten().cast(pa.float64())
    found = np.asarray(values.to_numpy(zero_copy_only=False), float).reshape(-1, dim)  # nulls are NaN
    fine = np.isfinite(found).all(axis=1) if dim else np.ones(len(found), bool)
    mask = np.asarray(right.to_numpy(zero_copy_only=False), bool)
    mask[np.flatnonzero(mask)[~fine]] = False
    return mask, found[fine]


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of a matrix as lists."""
    ends = np.arange(0, values.size + 1, max(1, values.shape[1]), dtype=np.int32) if values.shape[1] else np.zeros(len(values) + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(values).ravel(), kind))


def commonest_length(df: DataFrame, vector_col: str) -> int:
    """The number of components that most vectors have, the smaller of two; 0 if there is none."""
    found = df.where(F.col(vector_col).isNotNull()).groupBy(F.size(vector_col).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return found["d"] if found else 0
