"""Exact k-means on vectors of whole numbers, with a filter in rotated coordinates.

One pass gives the covariance of all vectors; its eigenvectors, largest first, are the rotation. Of each vector the
table keeps its leading rotated coordinates (as many as hold LEADING of the variance) and the norm of the rest, in
single precision. For a vector and a centroid, the squared distance of the leading coordinates plus the squared
difference of the two rest norms is at most their squared distance, so a centroid whose bound exceeds the distance to
one already measured is out. Centroids are tried in the order of their bounds, in whole numbers: the filter only saves
work, and results do not depend on it (a margin covers the rounding of the bounds).

Every round reads the same table; tasks add up their vectors by centroid, so what is shuffled and brought to the
driver is `k` rows of sums, whatever the number of vectors or the size of a cluster.

Cases: vectors that are null, of another length than `width`, or hold null or non-finite components take no part, nor
do those whose whole numbers exceed vectors.largest_component (189,812,530 for 64 components), where distances do not
fit 64 bits; null ids take part, and come last as seeds; rows that repeat an id are vectors of their own; ties go
to the smaller number; fewer than k vectors are as many centroids; an empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut
from .vectors import matrix, sums_by, whole_vectors

#: Share of the variance in the leading coordinates, and the share of the squared norms that rounding may take from a bound.
LEADING, MARGIN = 0.75, 1e-6


@dataclass(frozen=True)
class Rotation:
    mean: np.ndarray
    axes: np.ndarray
    leading: int

    def split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates and the norm of the others."""
        turned = (x - self.mean) @ self.axes
        return turned[:, : self.leading], np.sqrt((turned[:, self.leading :] ** 2).sum(axis=1))


def fit_rotation(rows: DataFrame, width: int) -> Rotation:
    """Principal axes of the column v over all rows."""

    def moments(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1))
        for batch in it:
            if batch.num_rows:
                x = np.column_stack([np.ones(batch.num_rows), matrix(batch.column(0))])
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(width + 1), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "m"])

    sums = rows.select("v").mapInArrow(moments, "i int, m array<double>").groupBy("i").agg(*(F.sum(F.get("m", F.lit(j))).alias(f"m{j}") for j in range(width + 1)))
    found = np.zeros((width + 1, width + 1))
    for r in sums.collect():
        found[r["i"]] = r[1:]
    n = max(found[0, 0], 1.0)
    mean = found[0, 1:] / n
    values, axes = np.linalg.eigh(found[1:, 1:] / n - np.outer(mean, mean))
    held = np.cumsum(np.maximum(values[::-1], 0))
    return Rotation(mean, axes[:, ::-1], int(np.searchsorted(held, LEADING * held[-1])) + 1)


def assign(v: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, rotation: Rotation) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smaller of equals) and the squared distance to it, in whole numbers."""
    c_lead, c_rest = rotation.split(centroids)
    own, other = (lead**2).sum(axis=1)[:, None], (c_lead**2).sum(axis=1)[None]
    norms = own + other + rest[:, None] ** 2 + c_rest[None] ** 2
    bounds = own + other - 2 * lead @ c_lead.T + (rest[:, None] - c_rest[None]) ** 2 - MARGIN * norms
    order = np.argsort(bounds, axis=1)
    number, least = np.full(len(v), len(centroids), np.int64), np.full(len(v), np.iinfo(np.int64).max)
    open_rows = np.arange(len(v))
    for rank in range(len(centroids)):
        c = order[open_rows, rank]
        near = bounds[open_rows, c] <= least[open_rows]
        open_rows, c = open_rows[near], c[near]
        if not len(open_rows):
            break
        d = ((v[open_rows] - centroids[c]) ** 2).sum(axis=1)
        better = (d < least[open_rows]) | ((d == least[open_rows]) & (c < number[open_rows]))
        number[open_rows[better]], least[open_rows[better]] = c[better], d[better]
    return number, least


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, scale: int = 256, width: int = 64, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster and distance of every vector, cluster_inertia and inertia (distances summed over its cluster and
    over all) and the SHA-256 of its cluster's centroid.

    Centroids start as the k vectors of least SHA-256 of `seed:vec_id`.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, scale, width, vector_col, vec_id=id_col)
    rotation = fit_rotation(rows, width)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select("v").orderBy(digest.asc_nulls_last(), "v").limit(k).collect()
    centroids = np.array([r["v"] for r in first], np.int64).reshape(-1, width)

    def rotate(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                lead, rest = rotation.split(matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lead.astype(np.float32).tolist(), pa.list_(pa.float32())), pa.array(rest, pa.float32())], names=["vec_id", "v", "lead", "rest"])

    id_type = rows.schema["vec_id"].dataType.simpleString()
    stored = cut(rows.mapInArrow(rotate, f"vec_id {id_type}, v array<int>, lead array<float>, rest float"), "rotated")

    def parts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v, lead, rest = batch.columns[-3:]
        return matrix(v), lead.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1), rest.to_numpy(zero_copy_only=False).astype(float)

    for _ in range(rounds):

        def add(it: Iterator[pa.RecordBatch], centroids: np.ndarray = centroids) -> Iterator[pa.RecordBatch]:
            count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), width), np.int64)
            for batch in it:
                if batch.num_rows:
                    v, lead, rest = parts(batch)
                    n, s = sums_by(assign(v, lead, rest, centroids, rotation)[0], len(centroids), v)
                    count, total = count + n, total + s
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], names=["c", "n", "s"])

        sums = stored.select("v", "lead", "rest").mapInArrow(add, "c int, n long, s array<long>").groupBy("c").agg(F.sum("n"), *(F.sum(F.get("s", F.lit(j))) for j in range(width)))
        centroids = centroids.copy()
        for c, n, *s in sums.collect():
            centroids[c] = [x // n for x in s]

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                number, least = assign(*parts(batch), centroids, rotation)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number.astype(np.int32)), pa.array(least)], names=["vec_id", "cluster", "distance"])

    placed = cut(stored.mapInArrow(place, f"vec_id {id_type}, cluster int, distance long"), "clusters")
    inertia = {r["cluster"]: r["d"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    total = sum(inertia.values())
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    each = spark.createDataFrame([(c, d, total, digests[c]) for c, d in sorted(inertia.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
