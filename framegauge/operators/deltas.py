"""Cell delta ledgers: the changed cells between target frames and the base frames that they are mapped to.

Tables: ledgers(ledger_id, schema, target_count, mapping array<int>, digests array<string>), bases(ledger_id, base, w, h),
cells of bases (ledger_id, base, x, y, rgb) and of targets (ledger_id, frame, x, y, rgb), targets(ledger_id, frame, w, h)
and deltas(ledger_id, place, frame, x, y, before, after), the last two colours as arrays of red, green, blue and alpha.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evidence import first_reason
from .ledger import placed, scanned

# The schema tag and the reason codes, without what they begin with.
SCHEMA, PREFIX = "cell-delta-ledger/0", "invalid_cell_delta_ledger_"


def frame_digests(frames: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """ledger_id, key and sha256 of each frame: its size and its cells in order of rows and columns."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "rgb"))), lambda c: F.concat_ws(",", c["x"], c["y"], c["rgb"])), ";")
    lists = cells.groupBy("ledger_id", key).agg(text.alias("cells"))
    rows = frames.join(lists, ["ledger_id", key], "left")
    return rows.select("ledger_id", key, F.sha2(F.concat_ws("|", "w", "h", F.coalesce("cells", F.lit(""))), 256).alias("sha256"))


def rgba(rgb: Column) -> Column:
    """A colour as red, green, blue and alpha; all 0 for an empty cell."""
    parts = F.array(F.shiftright(rgb, 16), F.shiftright(rgb, 8).bitwiseAND(255), rgb.bitwiseAND(255), F.lit(255))
    return F.when(rgb.isNull(), F.array(*(F.lit(0) for _ in range(4)))).otherwise(parts)


def _mapped(ledgers: DataFrame) -> DataFrame:
    return ledgers.select("ledger_id", F.posexplode("mapping").alias("frame", "base"))


def build_ledgers(ledgers: DataFrame, bases: DataFrame, base_cells: DataFrame, targets: DataFrame, target_cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The deltas of each ledger's targets in order of (frame, y, x), place from 0; and the ledgers refused, with reason.

    ledgers(ledger_id, mapping): mapping has a base for each target. Refused are mappings of another length, of a base
    that is not there, or of one of another size than the target; refused ledgers have no deltas.
    """
    sizes = targets.groupBy("ledger_id").agg(F.count("*").alias("n"))
    pairs = _mapped(ledgers).join(bases, ["ledger_id", "base"], "left").join(targets.select("ledger_id", "frame", F.col("w").alias("tw"), F.col("h").alias("th")), ["ledger_id", "frame"], "left")
    faults = pairs.groupBy("ledger_id").agg(F.bool_or(F.col("w").isNull()).alias("unknown"), F.bool_or((F.col("w") != F.col("tw")) | (F.col("h") != F.col("th"))).alias("sized"))
    rows = ledgers.join(sizes, "ledger_id", "left").join(faults, "ledger_id", "left")
    reason = first_reason((F.coalesce(F.size("mapping"), F.lit(-1)) != F.coalesce("n", F.lit(0)), PREFIX + "target_count"), (F.coalesce("unknown", F.lit(False)), PREFIX + "mapping"), (F.coalesce("sized", F.lit(False)), PREFIX + "bounds"))
    judged = rows.select("ledger_id", reason.alias("reason"))
    good = judged.filter("reason is null").select("ledger_id")
    before = _mapped(ledgers.join(good, "ledger_id")).join(base_cells, ["ledger_id", "base"]).select("ledger_id", "frame", "x", "y", F.col("rgb").alias("p"))
    after = target_cells.join(good, "ledger_id").select("ledger_id", "frame", "x", "y", F.col("rgb").alias("q"))
    changed = before.join(after, ["ledger_id", "frame", "x", "y"], "full_outer").filter(~F.col("p").eqNullSafe(F.col("q")))
    deltas = placed(changed, "ledger_id", ["frame", "y", "x"]).select("ledger_id", (F.col("place") - 1).alias("place"), "frame", "x", "y", rgba(F.col("p")).alias("before"), rgba(F.col("q")).alias("after"))
    return deltas, judged.filter("reason is not null")


def check_ledgers(ledgers: DataFrame, bases: DataFrame, base_cells: DataFrame, deltas: DataFrame) -> DataFrame:
    """ledger_id, reason, place, frame, x, y: the first fault of each ledger (null for sound ones).

    What the ledger says of itself comes first (schema, digests, mapping, count); then its rows in order, each by the
    rules: coordinates, a cell twice, order, bounds, colours (four numbers, alpha 0 or 255), no change, and a `before`
    that the base frame has not. The row before a row is found by a segmented scan, so a ledger may have any size.
    """
    actual = frame_digests(bases, base_cells, "base").groupBy("ledger_id").agg(F.array_sort(F.collect_list(F.struct("base", "sha256")))["sha256"].alias("actual"))
    head = ledgers.join(actual, "ledger_id", "left").withColumn("actual", F.coalesce("actual", F.array().cast("array<string>")))
    hexes = F.forall("digests", lambda d: F.coalesce(d.rlike("^[0-9a-f]{64}$"), F.lit(False)))
    inside = F.forall("mapping", lambda b: F.coalesce((b >= 0) & (b < F.size("actual")), F.lit(False)))
    said = first_reason(
        (~F.col("schema").eqNullSafe(F.lit(SCHEMA)), PREFIX + "schema"), (F.col("digests").isNull() | ~hexes | (F.size("digests") != F.size("actual")), PREFIX + "digest"), (F.col("digests") != F.col("actual"), "base_frame_hash_mismatch"),
        (F.col("mapping").isNull(), PREFIX + "mapping"), (F.coalesce(F.col("target_count") != F.size("mapping"), F.lit(True)), PREFIX + "target_count"), (~inside, PREFIX + "mapping"),
    )
    head = head.select("ledger_id", said.alias("said"), "target_count", "mapping").withColumn("known", F.lit(True))

    cell = ["ledger_id", "frame", "y", "x"]
    rows = scanned(deltas, "ledger_id", ["place"], F.struct("frame", "y", "x")).drop("_place", "_sum")
    twice = deltas.groupBy(*cell).agg(F.min("place").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    rows = rows.join(twice, cell, "left").join(_mapped(ledgers), ["ledger_id", "frame"], "left").join(bases, ["ledger_id", "base"], "left")
    rows = rows.join(base_cells.withColumnRenamed("rgb", "own"), ["ledger_id", "base", "x", "y"], "left").join(head.select("ledger_id", "target_count"), "ledger_id", "left")
    colour = lambda c: F.coalesce((F.size(c) == 4) & F.forall(c, lambda v: v.isNotNull() & (v >= 0) & (v <= 255)) & F.get(c, F.lit(3)).isin(0, 255), F.lit(False))
    here = F.struct("frame", "y", "x")
    reason = first_reason(
        (F.col("frame").isNull() | F.col("x").isNull() | F.col("y").isNull(), PREFIX + "bounds"), (F.col("place") > F.col("_first"), PREFIX + "duplicate"), (here < F.col("_before"), PREFIX + "order"),
        ((F.col("frame") < 0) | F.coalesce(F.col("frame") >= F.col("target_count"), F.lit(True)) | F.col("w").isNull(), PREFIX + "bounds"), ((F.col("x") < 0) | (F.col("x") >= F.col("w")) | (F.col("y") < 0) | (F.col("y") >= F.col("h")), PREFIX + "bounds"),
        (~colour("before") | ~colour("after"), PREFIX + "alpha"), (F.col("before") == F.col("after"), PREFIX + "noop"), (F.col("before") != rgba(F.col("own")), PREFIX + "from"),
    )
    bad = rows.withColumn("reason", reason).filter("reason is not null").groupBy("ledger_id").agg(F.min(F.struct("place", "reason", "frame", "x", "y")).alias("bad"))
    out = head.join(bad, "ledger_id", "left")
    first = F.when(F.col("said").isNull(), F.col("bad"))
    return out.select("ledger_id", F.coalesce("said", "bad.reason").alias("reason"), *(first[c].alias(c) for c in ("place", "frame", "x", "y")))
