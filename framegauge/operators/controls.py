"""Controls and calibration: budgets from promoted controls, rescoring, adversarial and coverage summaries, corpus counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical_constant, canonical_json
from ..functions.scalars import alpha_budget, canonical
from .evidence import contract, first_reason
from .gates import isolation
from .pairs import adjacent, anchors, best_shift, displacement_flags, masks, shift_scores


def separated_controls(profiles: DataFrame, promotions: DataFrame, measurements: DataFrame) -> DataFrame:
    """motion_class, gate, control (metric), attempt_id, caveats and reason of every SEPARATED profile.

    The profile's promotion must be ACTIVE and its measurement must have a metric for the gate. profiles: motion_class,
    gate, status, active_promotion; promotions: id, attempt_id, measurement_path, status; measurements: path, gate,
    metric, caveats. Reasons: no_promotion, unknown_promotion, not_active, invalid_measurement.
    """
    rows = profiles.filter("status = 'SEPARATED'").select("motion_class", "gate", F.col("active_promotion").alias("id"))
    rows = rows.join(promotions.select("id", "attempt_id", F.col("measurement_path").alias("path"), F.col("status").alias("promotion")), "id", "left")
    rows = rows.join(measurements.select("path", "gate", F.col("metric").alias("control"), "caveats"), ["path", "gate"], "left")
    reason = first_reason((F.col("id").isNull(), "no_promotion"), (F.col("promotion").isNull(), "unknown_promotion"), (F.col("promotion") != "ACTIVE", "not_active"), (F.col("control").isNull(), "invalid_measurement"))
    return rows.select("motion_class", "gate", "control", "attempt_id", F.coalesce("caveats", F.array().cast("array<string>")).alias("caveats"), reason.alias("reason"))


def derive_budgets(profiles: DataFrame, worst: DataFrame, controls: DataFrame, alpha: float = 0.5) -> DataFrame:
    """One row for each profile: derived budget, headroom and review width, its difference to the one in use, or a reason.

    worst: motion_class, gate, good, sample; SEPARATED pairs get canonical(G + alpha (C - G)), UNSEPARATED ones keep the
    budget in use and have the headroom over G, INAPPLICABLE ones have neither.
    """
    rows = profiles.select("motion_class", "gate", "status", F.col("budget").alias("old")).join(worst, ["motion_class", "gate"], "left")
    rows = rows.join(controls.select("motion_class", "gate", "control", F.col("reason").alias("blocked")), ["motion_class", "gate"], "left")
    g, c = canonical("good"), canonical("control")
    derived = F.when(F.col("status") == "SEPARATED", alpha_budget(g, c, alpha)).when(F.col("status") == "UNSEPARATED", F.col("old"))
    tenth = lambda x: F.floor(x * 10000 + 0.5) / 10000
    separated = F.col("status") == "SEPARATED"
    reason = first_reason(
        (F.col("status") == "INAPPLICABLE", "inapplicable"), (F.col("good").isNull(), "no_good_sample"), (F.col("old").isNull(), "no_budget_in_use"),
        (separated & F.col("blocked").isNotNull(), "blocked_control"), (separated & F.col("control").isNull(), "blocked_control"), (separated & derived.isNull(), "no_gap"),
    )
    rows = rows.withColumns({"g": g, "c": c, "derived": derived, "why": reason})
    fine = lambda x: F.when(F.col("why").isNull(), x)
    return rows.select(
        "motion_class", "gate", "status", "sample", fine(F.col("derived")).alias("budget"), fine(tenth(F.col("derived") - F.col("old"))).alias("delta"),
        fine(tenth(F.col("derived") - F.col("g"))).alias("headroom"), F.when(F.col("why").isNull() & separated, tenth(F.col("c") - F.col("derived"))).alias("review_width"), F.col("why").alias("reason"),
    )


def rescore(gate_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gate rows under the canonical metric and the isolation that follows, each with the schema and digest rescored.

    gate_rows: run_id, target_gate, gate, metric, budget, outcome, schema, config, rescore_of (struct of schema and
    config; null where a run is rescored for the first time). Outcomes without metric or budget stay as they are.
    """
    metric = canonical("metric")
    outcome = F.when(F.col("metric").isNull() | F.col("budget").isNull(), F.col("outcome")).otherwise(F.when(metric <= F.col("budget"), "pass").otherwise("fail"))
    of = F.coalesce("rescore_of", F.struct("schema", "config"))
    rows = gate_rows.withColumns({"metric_raw": F.col("metric"), "rescore_of": of}).withColumns({"was": F.col("outcome"), "outcome": outcome, "metric": metric})
    verdicts = isolation(rows.select("run_id", "gate", "target_gate", "outcome")).select("run_id", "target_gate", "isolation", "blockers", "caveats")
    return rows, verdicts.join(rows.groupBy("run_id").agg(F.first("rescore_of", True).alias("rescore_of")), "run_id")


def adversarial_summary(results: DataFrame, baselines: DataFrame, must_fail: DataFrame, gaps: DataFrame) -> DataFrame:
    """verdict and want of each strip under each mutation, by the first rule that applies.

    results: strip_id, sample, motion_class, mutation (baseline for the untouched strip), outcome, displacement (true,
    false, or null for undecidable); baselines: motion_class, outcome wanted of untouched strips; must_fail:
    motion_class, mutation; gaps: sample, mutation, gap (a documented hole). Order: the baseline's outcome; mutations
    that must not pass; documented gaps; hops and slides of ungrounded strips, where displacement found them (must not
    pass) or can't be told (GAP); all else must pass.
    """
    rows = results.join(F.broadcast(baselines.select("motion_class", F.col("outcome").alias("calm"))), "motion_class", "left")
    rows = rows.join(F.broadcast(must_fail.select("motion_class", "mutation", F.lit(True).alias("must"))), ["motion_class", "mutation"], "left")
    rows = rows.join(gaps.select("sample", "mutation", "gap"), ["sample", "mutation"], "left")
    moved = F.col("mutation").isin("hop", "slide") & (F.col("motion_class") == "airborne")
    want = (
        F.when(F.col("mutation") == "baseline", F.coalesce("calm", F.lit("PASS"))).when(F.coalesce("must", F.lit(False)), "not PASS").when(F.col("gap").isNotNull(), "not PASS (ungated)")
        .when(moved & (F.col("displacement") == False), "not PASS").when(moved & F.col("displacement").isNull(), "not PASS (inapplicable)").otherwise("PASS")  # noqa: E712
    )
    verdict = (
        F.when(F.col("want").startswith("not PASS ("), "GAP").when(F.when(F.col("want") == "not PASS", F.col("outcome") != "PASS").otherwise(F.col("outcome") == F.col("want")), "ok").otherwise("MISMATCH")
    )
    return rows.withColumn("want", want).withColumn("verdict", verdict).select("strip_id", "sample", "motion_class", "mutation", "outcome", "want", "verdict", "gap")


def tampered(cells: DataFrame, frames: DataFrame, probes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells and frames of every strip under every probe; probes: probe, mutation (hop, slide or none), frame, magnitude.

    The strips get the probe in their name: strip_id becomes a struct of strip_id and probe.
    """
    p = F.broadcast(probes.withColumnRenamed("frame", "at"))
    key = F.struct("strip_id", "probe")
    moved = cells.crossJoin(p).join(frames.select("strip_id", "frame", "w"), ["strip_id", "frame"])
    hit = lambda kind: (F.col("frame") == F.col("at")) & (F.col("mutation") == kind)
    moved = moved.withColumns({"x": F.when(hit("slide"), F.col("x") + F.col("magnitude")).otherwise(F.col("x")), "y": F.when(hit("hop"), F.col("y") - F.col("magnitude")).otherwise(F.col("y"))})
    moved = moved.filter((F.col("x") < F.col("w")) & (F.col("y") >= 0)).select(key.alias("strip_id"), "frame", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "rgb")
    return moved, frames.crossJoin(p.select("probe")).withColumn("strip_id", key).drop("probe")


def coverage_grid(cells: DataFrame, frames: DataFrame, classes: DataFrame, probes: DataFrame, span: int = 4) -> DataFrame:
    """Each strip under each probe: whether displacement flags the tampered frame, and how many other frames it flags.

    A probe of mutation none leaves the strip as it is, so all its flags are false positives of a clean cohort.
    """
    moved, all_frames = tampered(cells, frames, probes)
    strips = anchors(moved, all_frames, classes)
    flags = displacement_flags(strips, best_shift(shift_scores(adjacent(strips), masks(moved, all_frames), span, span)))
    flags = flags.select("strip_id.strip_id", "strip_id.probe", "frame").join(F.broadcast(probes.select("probe", F.when(F.col("mutation") != "none", F.col("frame")).alias("at"))), "probe")
    hits = flags.groupBy("strip_id", "probe").agg(F.bool_or(F.coalesce(F.col("frame") == F.col("at"), F.lit(False))).alias("detected"), F.count_if(~F.coalesce(F.col("frame") == F.col("at"), F.lit(False))).alias("others"))
    every = frames.select("strip_id", "motion_class").distinct().crossJoin(F.broadcast(probes))
    out = every.join(hits, ["strip_id", "probe"], "left")
    return out.select("strip_id", "motion_class", "probe", "mutation", "frame", "magnitude", F.coalesce("detected", F.lit(False)).alias("detected"), F.coalesce("others", F.lit(0)).alias("others"))


def corpus_summary(results: DataFrame, expectations: DataFrame, predictions: DataFrame, inapplicable: DataFrame) -> DataFrame:
    """One row: samples scored, pending, in regression against the contract, against their frozen prediction, inapplicable.

    results: id, tripped; expectations and predictions: id, expect, wanted; inapplicable: id.
    """
    now = contract(results, expectations).agg(F.count_if(F.col("state") != "pending").alias("scored"), F.count_if(F.col("state") == "pending").alias("pending"), F.count_if(F.col("state") == "regression").alias("regressions"))
    then = contract(results, predictions).agg(F.count_if(F.col("state") == "regression").alias("ledger_mismatches"))
    # one row each
    return now.crossJoin(F.broadcast(then)).crossJoin(F.broadcast(inapplicable.agg(F.count_distinct("id").alias("inapplicable"))))


def coherence_strict(cells: DataFrame, frames: DataFrame, most: float = 0.28) -> DataFrame:
    """All strict gates of a strip: sizes, lowest rows, their cells, palettes and changed colours between neighbours.

    changed over union counts cells in either frame; the pair around the end is loop closure. `pass` is the AND of all.
    """
    n = frames.groupBy("strip_id").agg(F.count("*").cast("int").alias("n"), (F.count_distinct(F.struct("w", "h")) == 1).alias("dimension_parity"))
    per_frame = cells.groupBy("strip_id", "frame").agg(F.max("y").alias("low"), F.array_sort(F.collect_set("rgb")).alias("palette"))
    per_frame = frames.select("strip_id", "frame").join(per_frame, ["strip_id", "frame"], "left")
    same = per_frame.groupBy("strip_id").agg((F.count_distinct(F.coalesce("low", F.lit(-1))) == 1).alias("baseline_row_stable"), (F.count_distinct(F.coalesce("palette", F.array().cast("array<int>"))) == 1).alias("palette_set_equal"))
    pairs = adjacent(n.select("strip_id", "n"), F.lit(True)).select("strip_id", "a", "b")
    lows = per_frame.select("strip_id", "frame", "low")
    pairs = pairs.join(lows.withColumnsRenamed({"frame": "a", "low": "low_a"}), ["strip_id", "a"]).join(lows.withColumnsRenamed({"frame": "b", "low": "low_b"}), ["strip_id", "b"])
    side = lambda own, name: pairs.join(cells.withColumnsRenamed({"frame": own, "rgb": name}), ["strip_id", own])
    both = side("a", "p").join(side("b", "q").select("strip_id", "a", "b", "x", "y", "q"), ["strip_id", "a", "b", "x", "y"], "full_outer")
    sums = both.groupBy("strip_id", "a", "b").agg(F.count("*").alias("union"), F.count_if(~F.col("p").eqNullSafe(F.col("q"))).alias("changed"))
    # each frame's lowest row must have the same colours at the same x, wherever it lies
    floor = lambda own, name: pairs.join(cells.withColumnRenamed("frame", own), ["strip_id", own]).filter(F.col("y") == F.col(f"low_{own}")).select("strip_id", "a", "b", "x", "rgb", F.lit(1).alias(name))
    moved = floor("a", "p").join(floor("b", "q"), ["strip_id", "a", "b", "x", "rgb"], "full_outer").filter("p is null or q is null").select("strip_id", "a", "b").distinct().withColumn("moved", F.lit(True))
    rows = pairs.select("strip_id", "a", "b").join(sums, ["strip_id", "a", "b"], "left").join(moved, ["strip_id", "a", "b"], "left")
    frac = F.when(F.coalesce("union", F.lit(0)) > 0, F.floor(F.col("changed") / F.col("union") * 10000 + 0.5) / 10000).otherwise(F.lit(0.0))
    gates = rows.withColumn("frac", frac).groupBy("strip_id").agg(
        F.count("moved").alias("m"), F.max(F.when(F.col("b") > 0, F.col("frac"))).alias("worst"), F.max(F.when(F.col("b") == 0, F.col("frac"))).alias("loop"))
    out = n.join(same, "strip_id").join(gates, "strip_id", "left")
    out = out.select(
        "strip_id", "dimension_parity", "baseline_row_stable", (F.coalesce("m", F.lit(0)) == 0).alias("baseline_cells_locked"), (F.coalesce("worst", F.lit(0.0)) <= most).alias("adjacent_diff_budget"),
        (F.coalesce("loop", F.lit(0.0)) <= most).alias("loop_closure_pass"), "palette_set_equal", F.coalesce("worst", F.lit(0.0)).alias("worst"), F.coalesce("loop", F.lit(0.0)).alias("loop"),
    )
    names = ("dimension_parity", "baseline_row_stable", "baseline_cells_locked", "adjacent_diff_budget", "loop_closure_pass", "palette_set_equal")
    every: Column = F.lit(True)
    for c in names:
        every = every & F.col(c)
    return out.withColumn("pass", every)



def config_digests(profiles: DataFrame, promotions: DataFrame, measurements: DataFrame, policy: dict) -> DataFrame:
    """config_id, digest (16 digits) and reason of each gate configuration: its profiles, what its ACTIVE promotions rest
    on, and the numeric policy, as canonical JSON.

    profiles: config_id, motion_class, gate, status, budget, hard_fail, active_promotion; promotions: config_id, id,
    specification_id, attempt_id, measurement_path, status; measurements: path, raw_sha256. An active promotion without
    its measurement is missing_measurement, and a class with a gate twice duplicate_gate; both have no digest.
    """
    gates = profiles.select("config_id", "motion_class", "gate", F.struct("status", "budget", "hard_fail", "active_promotion").alias("p"))
    twice = gates.groupBy("config_id", "motion_class", "gate").agg(F.count("*").alias("n"), F.min("p").alias("p"))
    classes = twice.groupBy("config_id", "motion_class").agg(F.map_from_entries(F.collect_list(F.struct("gate", "p"))).alias("gates"), F.max("n").alias("n"))
    configs = classes.groupBy("config_id").agg(F.map_from_entries(F.collect_list(F.struct("motion_class", "gates"))).alias("acceptance_profiles"), F.max("n").alias("n"))
    active = promotions.filter("status = 'ACTIVE'").join(measurements.select(F.col("path").alias("measurement_path"), F.col("raw_sha256").alias("measurement_raw_sha256"), F.lit(True).alias("there")), "measurement_path", "left")
    rows = F.array_sort(F.collect_list(F.struct("id", "specification_id", "attempt_id", "measurement_raw_sha256")))
    active = active.groupBy("config_id").agg(rows.alias("active_promotions"), F.bool_or(F.col("there").isNull()).alias("missing"))
    both = configs.join(active, "config_id", "left").withColumn("active_promotions", F.coalesce("active_promotions", F.expr("cast(array() as array<struct<id:string,specification_id:string,attempt_id:string,measurement_raw_sha256:string>>)")))
    part = lambda c: canonical_json(F.col(c), both.schema[c].dataType)
    text = F.concat(F.lit('{"acceptance_profiles":'), part("acceptance_profiles"), F.lit(',"active_promotions":'), part("active_promotions"), F.lit(',"numeric_policy":'), canonical_constant(policy), F.lit("}"))
    reason = F.when(F.col("n") > 1, "duplicate_gate").when(F.col("missing"), "missing_measurement")
    return both.select("config_id", F.when(reason.isNull(), F.substring(F.sha2(text, 256), 1, 16)).alias("digest"), reason.alias("reason"))
