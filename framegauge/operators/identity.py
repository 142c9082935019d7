"""Search of a single landmark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def landmark(cells: DataFrame, x: int, y: int, most: int) -> DataFrame:
    """The cell nearest to (x, y) within `most` in the larger coordinate, ties by y and x; strips without one are absent."""
    d = F.greatest(F.abs(F.col("x") - x), F.abs(F.col("y") - y))
    near = cells.withColumn("distance", d).filter(F.col("distance") <= most)
    best = near.groupBy("strip_id").agg(F.min(F.struct("distance", "y", "x")).alias("m"))
    return best.select("strip_id", "m.x", "m.y", "m.distance")
