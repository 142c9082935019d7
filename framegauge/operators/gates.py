"""Frame metrics, gate outcomes and isolation verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pairs import adjacent, all_pairs, best_shift, shift_scores

# Gates in reporting order, and what each failure asks for next.
GATE_ORDER = ("dimension_parity", "baseline_row_stable", "silhouette_budget", "displacement_pass", "loop_closure_pass", "min_pair_cohort_pass", "palette_drift_pass")
RETRY_INTENT = {
    "STRUCTURAL_RECOVERY_FAILED": "restate the grid/gutter constraint in the prompt",
    "GATE_UNDECIDABLE": "change the motion so alignment is well-posed",
    "TARGET_DEFECT_TOO_WEAK": "amplify the targeted defect",
    "COLLATERAL_GATE_FAILED": "hold the collateral dimension fixed",
}
GATE_QUESTION = {
    "silhouette_budget": ("Is the silhouette change between neighbouring frames one motion?", "adjacent"),
    "displacement_pass": ("Does a frame jump away from its neighbours and back?", "adjacent"),
    "loop_closure_pass": ("Does the last frame lead back into the first?", "loop"),
    "min_pair_cohort_pass": ("Do the frames move at all?", "cohort"),
    "palette_drift_pass": ("Do the colours stay the same from frame to frame?", "palette"),
}


def gate_ordinal(gate: Column | str) -> Column:
    return F.array_position(F.array(*(F.lit(g) for g in GATE_ORDER)), F.col(gate) if isinstance(gate, str) else gate)


def dimension_parity(frames: DataFrame) -> DataFrame:
    return frames.groupBy("strip_id").agg((F.count_distinct(F.struct("w", "h")) == 1).alias("dimension_parity"))


def baseline_stability(baselines: DataFrame, strips: DataFrame) -> DataFrame:
    """Whether every frame of a grounded strip has frame 0's baseline; null for ungrounded ones."""
    first = baselines.filter("frame = 0").select("strip_id", F.col("baseline").alias("anchor_row"))
    same = baselines.join(first, "strip_id").groupBy("strip_id").agg(F.bool_and(F.col("baseline").eqNullSafe(F.col("anchor_row"))).alias("stable"))
    return strips.join(same, "strip_id").select("strip_id", F.when(F.col("grounded"), F.col("stable")).alias("baseline_row_stable"))


def silhouettes(strips: DataFrame, rows: DataFrame) -> DataFrame:
    """adjacent_max, loop, max_pair, min_pair and orphan_max of each strip, unrounded."""
    adj = best_shift(shift_scores(adjacent(strips), rows, 1)).groupBy("strip_id").agg(
        F.max(F.when(F.col("b") > 0, F.col("frac"))).alias("adjacent_max"), F.max(F.when(F.col("b") == 0, F.col("frac"))).alias("loop"))
    both = best_shift(shift_scores(all_pairs(strips, True), rows, 1))
    one = both.filter("a < b").groupBy("strip_id").agg(F.max("frac").alias("max_pair"), F.min("frac").alias("min_pair"))
    orphan = both.groupBy("strip_id", "a").agg(F.min("frac").alias("near")).groupBy("strip_id").agg(F.max("near").alias("orphan_max"))
    return strips.select("strip_id").join(adj, "strip_id", "left").join(one, "strip_id", "left").join(orphan, "strip_id", "left")


def static_silhouette(strips: DataFrame, rows: DataFrame) -> DataFrame:
    """Largest share of unchanged occupancy between neighbours (1 for two empty frames), never around the end."""
    pairs = adjacent(strips, F.lit(False)).withColumn("anchor", F.lit(1 << 30))
    scores = best_shift(shift_scores(pairs, rows, 0))
    still = F.when(F.col("union") == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.col("changed") / F.col("union"))
    return scores.groupBy("strip_id").agg(F.max(still).alias("static"))


def histograms(cells: DataFrame) -> DataFrame:
    """(strip_id, frame, rgb, n, total): cells of each colour in a frame and of all."""
    counts = cells.groupBy("strip_id", "frame", "rgb").agg(F.count("*").alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy("strip_id", "frame")))


def palette_drift(strips: DataFrame, hists: DataFrame) -> DataFrame:
    """Total variation between the colours of neighbouring frames, the pair around the end included.

    Given as `distance` over 2 * na * nb, in whole numbers: sum of |x nb - y na| over the colours.
    """
    pairs = adjacent(strips, F.lit(True)).select("strip_id", "a", "b")
    left = pairs.join(hists.withColumnsRenamed({"frame": "a", "n": "x", "total": "na"}), ["strip_id", "a"])
    right = pairs.join(hists.withColumnsRenamed({"frame": "b", "n": "y", "total": "nb"}), ["strip_id", "b"])
    both = left.join(right, ["strip_id", "a", "b", "rgb"], "full_outer")
    sizes = hists.groupBy("strip_id", "frame").agg(F.max("total").alias("total"))
    both = both.select("strip_id", "a", "b", F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y"))
    both = both.join(sizes.withColumnsRenamed({"frame": "a", "total": "na"}), ["strip_id", "a"], "left").join(sizes.withColumnsRenamed({"frame": "b", "total": "nb"}), ["strip_id", "b"], "left")
    na, nb = F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0))
    grouped = both.groupBy("strip_id", "a", "b").agg(F.sum(F.abs(F.col("x") * F.greatest(nb, F.lit(1)) - F.col("y") * F.greatest(na, F.lit(1)))).alias("distance"), F.max(F.greatest(na, F.lit(1)) * F.greatest(nb, F.lit(1)) * 2).alias("whole"))
    return grouped.withColumn("tv", F.col("distance") / F.col("whole"))


def isolation(gate_rows: DataFrame) -> DataFrame:
    """gate_rows(run_id, gate, target_gate, outcome pass/fail/undecidable, metric, budget): verdict, blockers, number of
    caveats, and of a failure its code, gate, and that gate's metric_now and budget_now."""
    target, failed = F.col("gate") == F.col("target_gate"), F.col("outcome") == "fail"
    value = [F.col(c).cast("double").alias(c) if c in gate_rows.columns else F.lit(None).cast("double").alias(c) for c in ("metric", "budget")]
    rows = gate_rows.groupBy("run_id", "target_gate").agg(
        F.max(F.when(target, F.col("outcome"))).alias("target"), F.max(F.when(target, F.struct(*value))).alias("own"), F.count_if(~target & failed).alias("others"),
        F.array_sort(F.collect_list(F.when(~target & failed, F.col("gate")))).alias("collateral"), F.count_if(~target & (F.col("outcome") == "undecidable")).alias("caveats"),
        F.min(F.when(~target & failed, F.struct(gate_ordinal("gate").alias("o"), "gate", *value))).alias("first"),
    )
    verdict = F.when(F.col("target") == "undecidable", "INDETERMINATE").when((F.col("target") == "fail") & (F.col("others") == 0), "ISOLATED").otherwise("NOT_ISOLATED")
    code = (
        F.when(verdict == "ISOLATED", None).when(F.col("target") == "undecidable", "GATE_UNDECIDABLE")
        .when(F.col("target") == "pass", "TARGET_DEFECT_TOO_WEAK").otherwise("COLLATERAL_GATE_FAILED")
    )
    gate = F.when(code == "COLLATERAL_GATE_FAILED", F.col("first.gate")).when(code.isNotNull(), F.col("target_gate"))
    return rows.select("run_id", "target_gate", verdict.alias("isolation"), F.array_join("collateral", ",").alias("blockers"), "caveats", code.alias("code"), gate.alias("failed_gate"),
                       *(F.when(code == "COLLATERAL_GATE_FAILED", F.col(f"first.{c}")).when(code.isNotNull(), F.col(f"own.{c}")).alias(f"{c}_now") for c in ("metric", "budget")))


def retry_actions(failures: DataFrame) -> DataFrame:
    """Adds intent, direction, must_exceed (of a target that is too weak) and must_fall_below (of a collateral gate) to
    rows with code and budget_now."""
    pairs = [x for k, v in RETRY_INTENT.items() for x in (F.lit(k), F.lit(v))]
    weak, collateral = F.col("code") == "TARGET_DEFECT_TOO_WEAK", F.col("code") == "COLLATERAL_GATE_FAILED"
    return failures.withColumns({
        "intent": F.element_at(F.create_map(*pairs), F.col("code")), "direction": F.when(weak, "increase").when(collateral, "decrease"),
        "must_exceed": F.when(weak, F.col("budget_now")), "must_fall_below": F.when(collateral, F.col("budget_now")),
    })
