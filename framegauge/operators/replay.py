"""Whether stored drafts are what their bundle says they come from: derived anew as a plan, compared by frame digest
first and by cell only where digests differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut
from . import deltas, grid

CELL = ["bundle_id", "frame", "x", "y"]


def provider_drafts(sheets: DataFrame, origins: DataFrame, frame_w: int, gutter: int, margin: int, w: int, h: int, source_h: int) -> DataFrame:
    """Frames (bundle_id, frame, x, y, rgb) of provider sheets (bundle_id, x, y, rgb): sliced, brought to a w x h canvas and
    embedded at the bundle's origin (bundle_id, origin_x, origin_y)."""
    sliced = grid.slice_frames(sheets.withColumnRenamed("bundle_id", "strip_id"), frame_w, gutter, margin)
    canvas = grid.canonicalise(sliced, w, h, source_h).withColumnRenamed("strip_id", "bundle_id")
    moved = canvas.join(origins, "bundle_id")
    return moved.select("bundle_id", "frame", (F.col("x") + F.col("origin_x")).cast("int").alias("x"), (F.col("y") + F.col("origin_y")).cast("int").alias("y"), "rgb")


def ledger_drafts(ledgers: DataFrame, base_cells: DataFrame, changed: DataFrame) -> DataFrame:
    """Frames of cell-authored bundles: the mapped base frames with the ledger's cells set to `after` (alpha 0 empties)."""
    base = ledgers.select("ledger_id", F.posexplode("mapping").alias("frame", "base")).join(base_cells, ["ledger_id", "base"])
    base = base.select(F.col("ledger_id").alias("bundle_id"), "frame", "x", "y", "rgb")
    a = F.col("after")
    rgb = F.when(a[3] != 0, a[0] * 65536 + a[1] * 256 + a[2]).cast("int")
    return grid.replay(base, changed.select(F.col("ledger_id").alias("bundle_id"), "frame", "x", "y", rgb.alias("to_rgb")), CELL)


def first_divergence(stored: DataFrame, derived: DataFrame) -> DataFrame:
    """bundle_id, frame, x, y of the first cell, in order of frames, rows and columns, in which two frame tables differ."""
    def digests(cells: DataFrame, name: str) -> DataFrame:
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "rgb"))), lambda c: F.concat_ws(",", c["x"], c["y"], c["rgb"])), ";")
        return cells.groupBy("bundle_id", "frame").agg(F.sha2(text, 256).alias(name))

    differ = digests(stored, "a").join(digests(derived, "b"), ["bundle_id", "frame"], "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select("bundle_id", "frame")
    left, right = (c.join(differ, ["bundle_id", "frame"], "left_semi").select(*CELL, "rgb") for c in (stored, derived))
    return grid.cell_diff(left, right, CELL).groupBy("bundle_id").agg(F.min(F.struct("frame", "y", "x")).alias("f")).select("bundle_id", "f.frame", "f.x", "f.y")


def check_drafts(bundles: DataFrame, drafts: DataFrame, provider: DataFrame, ledgers: DataFrame, bases: DataFrame, base_cells: DataFrame, changed: DataFrame) -> DataFrame:
    """bundle_id, reason, frame, x, y for each of bundles(bundle_id, cell_authored); all null where drafts are reproduced.

    provider holds the derived frames of provider bundles (provider_drafts); a cell-authored bundle's ledger must be sound
    (deltas.check_ledgers) before it is replayed, and its first fault is the reason if it is not.
    """
    faults = deltas.check_ledgers(ledgers, bases, base_cells, changed).withColumnRenamed("ledger_id", "bundle_id").select("bundle_id", F.col("reason").alias("fault"), *(F.col(c).alias(f"at_{c}") for c in ("frame", "x", "y")))
    faults = cut(faults, "faults")
    authored = bundles.filter("cell_authored")
    sound = faults.filter("fault is null").select(F.col("bundle_id").alias("ledger_id"))
    replayed = ledger_drafts(ledgers.join(sound, "ledger_id", "left_semi"), base_cells, changed.join(sound, "ledger_id", "left_semi"))
    derived = provider.select(*CELL, "rgb").unionByName(replayed)
    broken = faults.filter("fault is not null").select("bundle_id")
    wrong = first_divergence(drafts.join(broken.join(authored, "bundle_id", "left_semi"), "bundle_id", "left_anti"), derived)
    rows = bundles.join(faults.join(authored.select("bundle_id"), "bundle_id", "left_semi"), "bundle_id", "left").join(wrong, "bundle_id", "left")
    reason = F.coalesce("fault", F.when(F.col("frame").isNotNull(), F.when(F.col("cell_authored"), "cell_delta_replay_mismatch").otherwise("draft_reproduction_mismatch")))
    return rows.select("bundle_id", reason.alias("reason"), *(F.coalesce(c, f"at_{c}").alias(c) for c in ("frame", "x", "y")))
