"""Part maps: every opaque cell of a figure belongs to exactly one part, and parts hang together as declared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import components

# The rules in order.
RULES = (
    "missing_required_part", "duplicate_cell_assignment", "invalid_part_map_cell", "unknown_parent", "unassigned_opaque_cell", "disconnected_part",
    "landmark_part_mismatch", "tool_not_carried", "material_part_mismatch",
)


def validate_parts(cells: DataFrame, claims: DataFrame, parts: DataFrame, required: Sequence[str], landmarks: Sequence[tuple[int, int, str]] = (), carried: str | None = None, materials: Sequence[tuple[str, Sequence[str], Sequence[str]]] = (), roles: DataFrame | None = None) -> DataFrame:
    """One row for each figure: strip_id and reason, the first rule of RULES that it breaks, null if none.

    cells(strip_id, x, y): opaque cells; claims(strip_id, part, x, y): cells that parts claim; parts(strip_id, part,
    parent). Parts that are required; landmarks (x, y, part that must own the place); the part that must have a parent
    and touch it (distance 1); materials (role, parts, parts that are left out): the cells of a role outside the left-out
    parts must be those of the parts; roles(strip_id, x, y, role).
    """
    figures = cells.select("strip_id").union(parts.select("strip_id")).distinct()
    found = []

    def broken(rule: str, rows: DataFrame) -> None:
        found.append(rows.select("strip_id", F.lit(RULES.index(rule)).alias("rule")))

    there = parts.select("strip_id", "part").distinct()
    wanted = figures.select("strip_id", F.explode(F.array(*(F.lit(p) for p in required))).alias("part"))
    broken("missing_required_part", wanted.join(there, ["strip_id", "part"], "left_anti"))
    owners = claims.groupBy("strip_id", "x", "y").agg(F.count("*").alias("n"), F.min("part").alias("owner"))
    both = owners.join(cells.select("strip_id", "x", "y", F.lit(True).alias("opaque")), ["strip_id", "x", "y"], "full_outer")
    broken("duplicate_cell_assignment", owners.filter("n > 1"))
    broken("invalid_part_map_cell", both.filter("opaque is null"))
    broken("unassigned_opaque_cell", both.filter("n is null"))
    orphans = parts.filter("parent is not null").join(there.withColumnRenamed("part", "parent"), ["strip_id", "parent"], "left_anti")
    broken("unknown_parent", orphans)
    # components are found for each part by itself: the part takes the place of the frame
    pieces = components(claims.select("strip_id", F.col("part").alias("frame"), "x", "y")).groupBy("strip_id", "frame").agg(F.count_distinct("component").alias("n"))
    broken("disconnected_part", pieces.filter("n > 1"))
    for x, y, part in landmarks:
        owned = owners.filter((F.col("x") == x) & (F.col("y") == y) & (F.col("owner") == part)).select("strip_id")
        broken("landmark_part_mismatch", figures.join(owned, "strip_id", "left_anti"))
    if carried:
        hand = parts.filter((F.col("part") == carried) & F.col("parent").isNotNull()).select("strip_id", "parent").join(claims.withColumnRenamed("part", "parent"), ["strip_id", "parent"])
        step = F.explode(F.sequence(F.lit(-1), F.lit(1)))
        reach = hand.select("strip_id", "x", "y").select("*", step.alias("i")).select("*", step.alias("j")).select("strip_id", (F.col("x") + F.col("i")).alias("x"), (F.col("y") + F.col("j")).alias("y")).distinct()
        touching = claims.filter(F.col("part") == carried).join(reach, ["strip_id", "x", "y"], "left_semi").select("strip_id").distinct()
        broken("tool_not_carried", figures.join(touching, "strip_id", "left_anti"))
    for role, own, left_out in materials:
        outside = claims.filter(F.col("part").isin(*left_out)).select("strip_id", "x", "y")
        shown = roles.filter(F.col("role") == role).select("strip_id", "x", "y").distinct().join(outside, ["strip_id", "x", "y"], "left_anti").withColumn("a", F.lit(1))
        claimed = claims.filter(F.col("part").isin(*own)).select("strip_id", "x", "y").distinct().withColumn("b", F.lit(1))
        broken("material_part_mismatch", shown.join(claimed, ["strip_id", "x", "y"], "full_outer").filter("a is null or b is null"))
    first = found[0]
    for rows in found[1:]:
        first = first.union(rows)
    first = first.groupBy("strip_id").agg(F.min("rule").alias("rule"))
    return figures.join(first, "strip_id", "left").select("strip_id", F.get(F.array(*(F.lit(r) for r in RULES)), F.col("rule")).alias("reason"))
