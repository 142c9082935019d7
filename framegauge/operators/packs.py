"""Asset packs: hash-bound reports and releases, palettes and timing; and edges of autotile sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evidence import binding_check, first_reason

N, E, S, W = 1, 2, 4, 8


def check_packs(assets: DataFrame, releases: DataFrame, reports: DataFrame, files: DataFrame, cells: DataFrame, palette: DataFrame, policy: DataFrame, schemas: dict[str, str]) -> DataFrame:
    """One row for each pack: outcome and the first reason, by rule and then by asset.

    assets: pack_id, ord, asset_id, kind, loop, durations (array), contact_frame, report_path, report_sha; releases:
    pack_id, asset_id, path, sha; reports: path, schema, outcome; files: path, actual (digest of what is there); cells:
    path, rgb of the released frames; palette: rgb; policy: asset_id, loop, durations, contact_frame; schemas: the
    report schema of each kind. Rules in order: metadata_kind, loop, durations, contact_frame (assets with a policy
    only), the report's path_escape, missing and mismatch, invalid_report, report_not_pass, the same of releases, and
    palette_violation.
    """
    # tables are merged: planned by their compressed size, they would be broadcast through the driver at many times that
    told = assets.join(policy.select("asset_id", F.col("loop").alias("p_loop"), F.col("durations").alias("p_durations"), F.col("contact_frame").alias("p_contact"), F.lit(True).alias("p")), "asset_id", "left")
    told = told.join(reports.select(F.col("path").alias("report_path"), F.col("schema").alias("report_schema"), F.col("outcome").alias("report_outcome")).hint("merge"), "report_path", "left")
    key = F.struct("pack_id", "asset_id")
    bound = binding_check(assets.select(key.alias("id"), F.col("report_path").alias("path"), F.col("report_sha").alias("digest")), files, "report")
    bound = bound.select("id.*", F.col("reason").alias("report_reason")).dropDuplicates(["pack_id", "asset_id"])
    wanted = F.element_at(F.create_map(*(F.lit(x) for kv in schemas.items() for x in kv)), F.col("kind"))
    has = F.col("p").isNotNull()
    rules = [
        (has & (F.col("kind") != "animation"), "metadata_kind"), (has & ~F.col("loop").eqNullSafe(F.col("p_loop")), "loop"), (has & ~F.col("durations").eqNullSafe(F.col("p_durations")), "durations"),
        (has & ~F.col("contact_frame").eqNullSafe(F.col("p_contact")), "contact_frame"),
    ]
    own = told.join(bound.hint("merge"), ["pack_id", "asset_id"], "left")
    metadata = own.select("pack_id", "ord", F.lit(0).alias("step"), first_reason(*rules).alias("reason"))
    invalid = ~F.col("report_schema").eqNullSafe(wanted)
    report = first_reason((F.col("report_reason").isNotNull(), "x"), (invalid, "invalid_report"), (F.coalesce(F.col("report_outcome") != "PASS", F.lit(True)), "report_not_pass"))
    reported = own.select("pack_id", "ord", F.lit(1).alias("step"), F.coalesce("report_reason", report).alias("reason"))
    rel = releases.join(assets.select("pack_id", "asset_id", "ord").hint("merge"), ["pack_id", "asset_id"])
    odd = cells.join(palette.select("rgb").distinct(), "rgb", "left_anti").select("path").distinct().withColumn("odd", F.lit(True))
    hashed = binding_check(rel.select(F.struct("pack_id", "ord", "path").alias("id"), "path", F.col("sha").alias("digest")), files, "release").select("id.*", F.col("reason").alias("bad"))
    released = hashed.join(odd.hint("merge"), "path", "left").select("pack_id", "ord", F.lit(2).alias("step"), F.coalesce("bad", F.when(F.col("odd"), F.lit("palette_violation"))).alias("reason"))
    faults = metadata.union(reported).union(released).filter("reason is not null")
    first = faults.groupBy("pack_id").agg(F.min(F.struct("step", "ord", "reason")).alias("f"))
    return assets.select("pack_id").distinct().join(first.hint("merge"), "pack_id", "left").select("pack_id", F.when(F.col("f").isNull(), "PASS").otherwise("FAIL").alias("outcome"), "f.reason")


def tile_edges(cells: DataFrame, size: int) -> DataFrame:
    """The four edges of each tile as the colours along it: tileset, variant, mask, side and edge; empty places are null.

    cells: tileset, variant, mask, x, y, rgb. Tiles without any cell have no row.
    """
    sides = F.array(
        F.when(F.col("y") == 0, F.struct(F.lit("north").alias("side"), F.col("x").alias("at"))), F.when(F.col("x") == size - 1, F.struct(F.lit("east").alias("side"), F.col("y").alias("at"))),
        F.when(F.col("y") == size - 1, F.struct(F.lit("south").alias("side"), F.col("x").alias("at"))), F.when(F.col("x") == 0, F.struct(F.lit("west").alias("side"), F.col("y").alias("at"))),
    )
    tiles = cells.select("tileset", "variant", "mask").distinct().select("*", F.explode(F.array(*(F.lit(s) for s in ("north", "east", "south", "west")))).alias("side"))
    rows = cells.select("tileset", "variant", "mask", "rgb", F.explode(F.filter(sides, lambda s: s.isNotNull())).alias("s")).select("tileset", "variant", "mask", "s.side", "s.at", "rgb")
    edges = rows.groupBy("tileset", "variant", "mask", "side").agg(F.map_from_entries(F.collect_list(F.struct("at", "rgb"))).alias("m"))
    line = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.try_element_at(F.col("m"), i))
    return tiles.join(edges, ["tileset", "variant", "mask", "side"], "left").select("tileset", "variant", "mask", "side", F.coalesce(line, F.array_repeat(F.lit(None).cast("int"), size)).alias("edge"))


def edge_report(edges: DataFrame, variants: Sequence[str]) -> DataFrame:
    """One row for each tileset: pairs and pair_failures, geometry_failures, whether exposed edges differ, outcome.

    Pairs: of one variant, a mask open to the east beside one open to the west, and one open to the south over one open
    to the north, must have equal edges. Geometry: every variant's edge of a mask must be that of the first variant.
    Exposed: all edges of the closed tile (mask 0) differ from those of the open one (mask 15) in the first variant.
    """
    bit = lambda b: F.col("mask").bitwiseAND(b) > 0
    found = None
    for side, opens, other, closes in (("east", E, "west", W), ("south", S, "north", N)):
        a = edges.filter((F.col("side") == side) & bit(opens)).select("tileset", "variant", F.col("mask").alias("mask_a"), F.col("edge").alias("a"))
        b = edges.filter((F.col("side") == other) & bit(closes)).select("tileset", "variant", F.col("mask").alias("mask_b"), F.col("edge").alias("b"))
        both = a.join(b, ["tileset", "variant"]).select("tileset", (~F.col("a").eqNullSafe(F.col("b"))).alias("bad"))
        found = both if found is None else found.union(both)
    pairs = found.groupBy("tileset").agg(F.count("*").alias("pairs"), F.count_if("bad").alias("pair_failures"))
    first = edges.filter(F.col("variant") == variants[0])
    shape = edges.filter(F.col("variant").isin(*variants[1:])).join(first.select("tileset", "mask", "side", F.col("edge").alias("first")), ["tileset", "mask", "side"])
    shape = shape.groupBy("tileset", "mask", "side").agg(F.bool_or(~F.col("edge").eqNullSafe(F.col("first"))).alias("bad")).groupBy("tileset").agg(F.count_if("bad").alias("geometry_failures"))
    ends = first.filter("mask = 0").select("tileset", "side", F.col("edge").alias("closed")).join(first.filter("mask = 15").select("tileset", "side", "edge"), ["tileset", "side"])
    ends = ends.groupBy("tileset").agg(F.bool_and(~F.col("edge").eqNullSafe(F.col("closed"))).alias("exposed"))
    rows = edges.select("tileset").distinct().join(pairs, "tileset", "left").join(shape, "tileset", "left").join(ends, "tileset", "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    good: Column = (none("pair_failures") == 0) & (none("geometry_failures") == 0) & F.coalesce("exposed", F.lit(False))
    return rows.select("tileset", none("pairs").alias("pairs"), none("pair_failures").alias("pair_failures"), none("geometry_failures").alias("geometry_failures"), F.coalesce("exposed", F.lit(False)).alias("exposed"), F.when(good, "PASS").otherwise("FAIL").alias("outcome"))
