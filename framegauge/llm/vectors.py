"""Vectors as whole numbers, shared by the exact clustering operators."""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def largest_component(width: int) -> int:
    """The size up to which squared distances between vectors of whole numbers fit 64 bits."""
    return isqrt((1 << 63) // (4 * max(width, 1))) - 1


def whole_vectors(vectors: DataFrame, scale: int, width: int, vector_col: str, **named: str) -> DataFrame:
    """The named columns and v, floor(scale * component) of each vector of `width` components, none null or not finite.

    Components of which the result exceeds largest_component(width) count as not finite.
    """
    v = F.col(vector_col).cast("array<double>")
    most = largest_component(width)
    rows = vectors.filter(F.size(vector_col) == width).select(*(F.col(c).alias(n) for n, c in named.items()), v.alias("v"))
    fine = F.forall("v", lambda c: F.coalesce(F.abs(c) * scale <= most, F.lit(False)))
    return rows.filter(fine).withColumn("v", F.transform("v", lambda c: F.floor(c * scale)).cast("array<int>"))


def common_width(vectors: DataFrame, vector_col: str, parts: int = 1) -> int:
    """The most frequent length (the smaller of equals) of vectors that can be cut into so many equal parts; 0 for none."""
    size = F.size(vector_col)
    found = vectors.filter((size > 0) & (size % parts == 0)).groupBy(size.alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return found[0]["n"] if found else 0


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column without nulls, as 64-bit whole numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def sums_by(group: np.ndarray, groups: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of rows and sum of the rows of x for each group."""
    order = np.argsort(group, kind="stable")
    found, starts = np.unique(group[order], return_index=True)
    count, total = np.bincount(group, minlength=groups), np.zeros((groups, x.shape[1]), np.int64)
    if len(found):
        total[found] = np.add.reduceat(x[order], starts, axis=0)
    return count, total
