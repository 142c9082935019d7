"""The coherence report of a strip: every gate, caveat and the outcome in one row, from one registration pass.

registration() compares all frames of a strip with each other at once: neighbours, the loop, all pairs and stillness
come from the same scores, and the wide search for displacement is made only where a strip's class has a least
sharpness. All of it stays with a strip's rows, which are dealt once by strip. reports() holds the numbers against the
profiles of a class. Numbers are whole ten-thousandths, rounded half to even on the exact ratio.

A fold of three values decides: a structural fault is a FAIL whatever the gates say; then any FAIL, then any REVIEW.
What cannot be decided (displacement where frames have no one best alignment) is no gate row but a caveat.

Cases: a strip without cells, with one frame or with empty frames has a report; frames of unequal size are compared
where both have rows, and the strip fails; a strip whose class is unknown has no report; a class without profiles, or
one to which palette drift does not apply, fails closed with a reason, as do a gate without a budget and one of an
unknown status; a gate that a class has no profile for does not apply.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut
from .grid import palettes
from .pairs import adjacent, best_shift, displacement, masks, shift_scores

#: Anchor of pairs of which all rows count and no shift is sought.
ALL_ROWS = 1 << 30

# Gates in the order in which outcomes are listed, and the wording of the one caveat.
OUTCOME_ORDER = ("silhouette_budget", "loop_closure_pass", "palette_drift_pass", "min_pair_cohort_pass", "static_silhouette_pass", "displacement_pass")
UNDECIDABLE = "degenerate alignment minimum (margin %.4f at %s); displacement undecidable"


def ten_thousandths(num: str, den: str) -> str:
    """num / den in whole ten-thousandths, half to even; 0 for a den of 0. As SQL text of two whole-number columns."""
    whole, rest = f"(({num}) * 10000 div ({den}))", f"(2 * (({num}) * 10000 % ({den})))"
    return f"if(({den}) = 0, 0L, {whole} + if({rest} > ({den}) or ({rest} = ({den}) and {whole} % 2 = 1), 1, 0))"


def strip_table(cells: DataFrame, frames: DataFrame, classes: DataFrame) -> DataFrame:
    """A row for each strip: its class, frames in order (size and baseline), and the anchor row of grounded ones.

    frames may have anchor_row, a declared anchor of the strip; otherwise frame 0's baseline is it.
    """
    declared = F.max("anchor_row") if "anchor_row" in frames.columns else F.lit(None).cast("int")
    low = cells.groupBy("strip_id", "frame").agg(F.max("y").alias("baseline"))
    rows = frames.join(low, ["strip_id", "frame"], "left").groupBy("strip_id", "motion_class").agg(
        F.array_sort(F.collect_list(F.struct("frame", "w", "h", "baseline"))).alias("frames"), declared.alias("declared"))
    rows = rows.join(F.broadcast(classes.select("motion_class", "grounded", "loops", "min_sharpness")), "motion_class")
    # frame 0's baseline may be null: then every pair has its own anchor, the baseline of its first frame
    return rows.selectExpr("*", "size(frames) as n", "if(grounded, coalesce(declared, frames[0].baseline), null) as anchor_row", "frames.baseline as baselines",
                           "size(array_distinct(transform(frames, f -> struct(f.w, f.h)))) = 1 as dimension_parity")


def drift(cells: DataFrame, strips: DataFrame, merge: int, most: int) -> DataFrame:
    """colours, clusters, palette and drift (a, b, distance, whole, tv of neighbours, the pair around the end included)
    of each strip on its shared palette.

    tv is distance / whole, half the sum of the differences of colour shares.
    """
    counts = cells.groupBy("strip_id", "frame", "rgb").agg(F.count("*").alias("n"), F.min(F.struct("frame", "y", "x")).alias("at"))
    colours = counts.groupBy("strip_id", "rgb").agg(F.sum("n").alias("n"), F.min("at").alias("at"))
    shared = palettes(colours, merge, most)
    bits = lambda c: (f"shiftright({c}, 16)", f"(shiftright({c}, 8) & 255)", f"({c} & 255)")
    distance = " + ".join(f"({p} - {q}) * ({p} - {q})" for p, q in zip(bits("rgb"), bits("e.rgb"), strict=True))
    mapped = counts.join(shared.select("strip_id", "palette"), "strip_id").selectExpr("strip_id", "frame", "n", f"array_min(transform(palette, (e, i) -> struct({distance} as d, i as i))).i as ord")
    hists = mapped.groupBy("strip_id", "frame", "ord").agg(F.sum("n").alias("n")).groupBy("strip_id").agg(F.collect_list(F.struct("frame", "ord", "n")).alias("hist"))
    rows = strips.select("strip_id", "n").join(shared, "strip_id", "left").join(hists, "strip_id", "left")
    rows = rows.selectExpr("strip_id", "coalesce(colours, 0) as colours", "coalesce(clusters, 0) as clusters", "coalesce(palette.rgb, array()) as palette", "n", "coalesce(hist, array()) as hist",
                           "transform(sequence(0, n - 1), k -> aggregate(filter(hist, h -> h.frame = k), 0L, (s, h) -> s + h.n)) as totals",
                           "transform(sequence(0, n - 1), k -> transform(sequence(0, coalesce(size(palette), 1) - 1), o -> aggregate(filter(hist, h -> h.frame = k and h.ord = o), 0L, (s, h) -> s + h.n))) as shares")
    na, nb = "greatest(coalesce(totals[a], 0), 1)", "greatest(coalesce(totals[(a + 1) % n], 0), 1)"
    apart = f"aggregate(zip_with(shares[a], shares[(a + 1) % n], (x, y) -> abs(coalesce(x, 0) * {nb} - coalesce(y, 0) * {na})), 0L, (s, x) -> s + x)"
    pairs = f"if(n < 2, array(), transform(sequence(0, n - 1), a -> struct(a as a, cast((a + 1) % n as int) as b, {apart} as distance, 2 * {na} * {nb} as whole)))"
    rows = rows.selectExpr("strip_id", "colours", "clusters", "palette", f"{pairs} as drift")
    return rows.withColumn("drift", F.expr(f"transform(drift, d -> struct(d.a as a, d.b as b, d.distance as distance, d.whole as whole, {ten_thousandths('d.distance', 'd.whole')} as tv))"))


def registration(cells: DataFrame, frames: DataFrame, classes: DataFrame, merge: int = 64, most: int = 16) -> DataFrame:
    """All numbers of each strip in one row.

    adjacent, pairs (a < b) and still are arrays of a, b, changed, union and frac, loop such a struct (null with one
    frame); adjacent_max, max_pair, min_pair, orphan_max, static_max and worst_drift are ten-thousandths; margin (least
    sharpness, null for classes without a floor), worst_pair and flags (frames moved out and back) tell of displacement.
    """
    strips = cut(strip_table(cells, frames, classes), "strips")
    rows = masks(cells, frames)
    every = strips.select("strip_id", "n", "anchor_row", "grounded", "frames", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("a"))
    every = every.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("b")).filter("a <> b")
    anchor = "if(grounded, coalesce(anchor_row, frames[a].baseline, frames[a].h), frames[0].h)"
    every = every.selectExpr("strip_id", "a", "b", f"explode(if(b = a + 1, array({anchor}, {ALL_ROWS}), array({anchor}))) as anchor")
    best = shift_scores(every, rows, 1).selectExpr("strip_id", "a", "b", f"anchor = {ALL_ROWS} as still", f"if(anchor = {ALL_ROWS}, filter(scores, s -> s.dx = 0)[0], scores[0]) as s")
    frac = f"if(still, if(s.union = 0, 10000L, {ten_thousandths('s.union - s.changed', 's.union')}), {ten_thousandths('s.changed', 's.union')})"
    found = best.selectExpr("strip_id", f"struct(a, b, still, s.changed as changed, s.union as union, {frac} as frac) as p").groupBy("strip_id").agg(F.array_sort(F.collect_list("p")).alias("all"))
    plain = "p -> struct(p.a as a, p.b as b, p.changed as changed, p.union as union, p.frac as frac)"
    named = {"adjacent": "not p.still and p.b = p.a + 1", "pairs": "not p.still and p.a < p.b", "still": "p.still", "back": "not p.still and p.b = 0 and p.a > 0"}
    found = found.selectExpr("strip_id", *(f"transform(filter(all, p -> {rule}), {plain}) as {name}" for name, rule in named.items()),
                             "transform(array_distinct(all.a), k -> array_min(filter(all, p -> not p.still and p.a = k).frac)) as near")

    sharp = strips.filter("min_sharpness is not null")
    wide = shift_scores(adjacent(sharp).withColumn("anchor", F.expr(anchor)), rows, 4, 4)
    u = "greatest(scores[{}].union, 1)".format
    margins = wide.selectExpr("strip_id", f"struct({ten_thousandths(f'scores[1].changed * {u(0)} - scores[0].changed * {u(1)}', f'{u(0)} * {u(1)}')} as margin, a, b) as m")
    margins = margins.groupBy("strip_id").agg(F.min("m").alias("m"))
    moved = displacement(sharp, best_shift(wide)).select("strip_id", "flags")

    out = strips.join(found, "strip_id", "left").join(drift(cells, strips, merge, most), "strip_id", "left").join(margins, "strip_id", "left").join(moved, "strip_id", "left")
    none = "array()"
    return out.selectExpr(
        "strip_id", "motion_class", "grounded", "loops", "min_sharpness", "n", "frames", "dimension_parity", "anchor_row", "baselines",
        "if(grounded, forall(baselines, b -> b <=> anchor_row), null) as baseline_row_stable",
        *(f"coalesce({c}, {none}) as {c}" for c in ("adjacent", "pairs", "still")), "get(filter(back, p -> p.a = n - 1), 0) as loop",
        "coalesce(array_max(adjacent.frac), 0L) as adjacent_max", "coalesce(array_max(pairs.frac), 0L) as max_pair", "coalesce(array_min(pairs.frac), 0L) as min_pair",
        "coalesce(array_max(near), 0L) as orphan_max", "coalesce(array_max(still.frac), 10000L) as static_max",
        "colours", "clusters", "palette", "drift", "coalesce(array_max(drift.tv), 0L) as worst_drift",
        "if(min_sharpness is null, null, coalesce(m.margin, 0L)) as margin", "if(m is null, null, concat(m.a, '→', m.b)) as worst_pair", f"coalesce(flags, {none}) as flags",
    )


def class_policies(profiles: DataFrame) -> DataFrame:
    """profiles(motion_class, gate, status, budget, hard_fail) as one map of gates for each class."""
    return profiles.groupBy("motion_class").agg(F.map_from_entries(F.collect_list(F.struct("gate", F.struct("status", "budget", "hard_fail")))).alias("policies"))


def reports(registered: DataFrame, profiles: DataFrame) -> DataFrame:
    """registered with displacement_pass, gates, caveats, structural_fail, reason_code, outcome and lenient_outcome.

    gates has a struct for each gate that applies: gate, status, metric, budget, hard_fail, outcome, reason, numerator
    and denominator (the first of the worst neighbours, or the loop). lenient_outcome counts a REVIEW as a PASS where
    every REVIEW comes from an UNSEPARATED gate.
    """
    rows = registered.join(F.broadcast(class_policies(profiles)), "motion_class", "left")
    worst = "array_max(transform(adjacent, p -> struct(p.frac as frac, -p.a as place, p.changed as changed, p.union as union)))"
    rows = rows.withColumns({
        "worst": F.expr(worst), "undecidable": F.expr("margin is not null and margin < min_sharpness * 10000"),
        "displacement_pass": F.expr("if(margin is null or margin < min_sharpness * 10000, null, size(flags) = 0)"),
    })
    shape = "named_struct('gate', '{}', 'shown', {}, 'metric', cast({} as double) / 10000, 'numerator', {}, 'denominator', {})".format
    no = "cast(null as bigint)"
    measured = [
        shape("silhouette_budget", "true", "adjacent_max", "worst.changed", "worst.union"), shape("loop_closure_pass", "loop is not null", "loop.frac", "loop.changed", "loop.union"),
        shape("palette_drift_pass", "true", "worst_drift", no, no), shape("min_pair_cohort_pass", "true", "min_pair", no, no), shape("static_silhouette_pass", "true", "static_max", no, no),
        shape("displacement_pass", "displacement_pass is not null", "if(displacement_pass, 10000, 0)", no, no),
    ]
    rows = rows.withColumn("shown", F.expr(f"filter(array({', '.join(measured)}), g -> g.shown and policies[g.gate].status <> 'INAPPLICABLE')"))
    reason = "case when p.status not in ('SEPARATED', 'UNSEPARATED') then 'unknown_status' when p.budget is null and g.gate <> 'displacement_pass' then 'missing_budget' end"
    outcome = f"""case when g.gate = 'displacement_pass' then if(g.metric = 1, 'PASS', 'REVIEW') when ({reason}) is not null then 'FAIL' when g.metric <= p.budget then 'PASS'
        when p.status = 'SEPARATED' and g.metric >= p.hard_fail then 'FAIL' else 'REVIEW' end"""
    gate = f"""named_struct('gate', g.gate, 'status', p.status, 'metric', g.metric, 'budget', p.budget, 'hard_fail', if(p.status = 'SEPARATED' and g.gate <> 'displacement_pass', p.hard_fail, null),
        'outcome', {outcome}, 'reason', {reason}, 'numerator', g.numerator, 'denominator', g.denominator)""".replace("p.", "policies[g.gate].")
    rows = rows.withColumn("gates", F.expr(f"transform(shown, g -> {gate})"))
    caveat = f"""if(undecidable and policies['displacement_pass'].status <> 'INAPPLICABLE', array(format_string('{UNDECIDABLE}', cast(margin as double) / 10000, coalesce(worst_pair, '?'))), array())"""
    rows = rows.withColumns({
        "structural_fail": F.expr("not dimension_parity or baseline_row_stable <=> false"), "caveats": F.expr(f"coalesce({caveat}, array())"),
        "reason_code": F.expr("case when policies is null then 'missing_profile' when coalesce(policies['palette_drift_pass'].status, 'INAPPLICABLE') = 'INAPPLICABLE' then 'drift_not_applicable' end"),
    })
    rows = rows.withColumn("gates", F.expr("coalesce(gates, array())"))
    fold = "case when structural_fail or reason_code is not null or array_contains(gates.outcome, 'FAIL') then 'FAIL' when exists(gates, g -> g.outcome = 'REVIEW' {}) then 'REVIEW' else 'PASS' end".format
    rows = rows.withColumns({"outcome": F.expr(fold("")), "lenient_outcome": F.expr(fold("and g.status <> 'UNSEPARATED'"))})
    return rows.drop("policies", "worst", "undecidable", "shown")


def gate_table(reported: DataFrame) -> DataFrame:
    """The gates of reports as rows: strip_id, motion_class and the fields of a gate."""
    return reported.select("strip_id", "motion_class", F.explode("gates").alias("g")).select("strip_id", "motion_class", "g.*")


def bundle_outcomes(bundles: DataFrame) -> DataFrame:
    """Adds outcome and decided_by to bundles(post_edit, identity, structural, provider, coherence: outcomes or null).

    In this order: a failed post-edit check, an identity lock that is not passed, a structural check that is not
    passed, a provider that is not passed, a post-edit check that is not passed, and then the coherence outcome. Null
    stands for a check that the bundle has not; structural, provider and coherence must be there, else FAIL.
    """
    rules = [("post_edit", "post_edit = 'FAIL'", "'FAIL'"), ("identity", "identity <> 'PASS'", "'FAIL'"), ("structural", "structural is null or structural <> 'PASS'", "coalesce(structural, 'FAIL')"),
             ("provider", "provider is null or provider <> 'PASS'", "coalesce(provider, 'FAIL')"), ("post_edit", "post_edit <> 'PASS'", "'FAIL'")]
    fold = lambda pick, last: F.expr("case " + " ".join(f"when {r[1]} then {pick(r)}" for r in rules) + f" else {last} end")
    return bundles.withColumns({"outcome": fold(lambda r: r[2], "coalesce(coherence, 'FAIL')"), "decided_by": fold(lambda r: f"'{r[0]}'", "'coherence'")})


def applicable_gates(classes: DataFrame, profiles: DataFrame) -> DataFrame:
    """motion_class, ordinal, gate and why: the gates that apply to a class, in reporting order; classes without any
    profile have one row with reason `unknown_class` in place of a gate."""
    rows = classes.join(class_policies(profiles), "motion_class", "left")
    on = "coalesce(policies['{0}'].status <> 'INAPPLICABLE', false)".format
    number = "concat('{0}=', policies['{1}'].budget)".format
    limited = lambda g: f"{on(g)} and policies['{g}'].budget is not null"
    rules = [
        ("dimension_parity", "true", "'structural'"), ("baseline_row_stable", f"grounded and {on('baseline_row_stable')}", "'grounded: true'"),
        ("silhouette_budget", limited("silhouette_budget"), number("max_silhouette", "silhouette_budget")), ("displacement_pass", f"not grounded and {on('displacement_pass')}", "'grounded: false'"),
        ("loop_closure_pass", f"loops and {limited('loop_closure_pass')}", number("max_loop", "loop_closure_pass")), ("min_pair_cohort_pass", f"loops and {limited('min_pair_cohort_pass')}", number("max_min_pair", "min_pair_cohort_pass")),
        ("palette_drift_pass", "true", "'always'"),
    ]
    every = ", ".join(f"named_struct('ordinal', {i}, 'gate', '{g}', 'why', if({rule}, {why}, null))" for i, (g, rule, why) in enumerate(rules))
    known = f"filter(array({every}), g -> g.why is not null)"
    none = "array(named_struct('ordinal', 0, 'gate', cast(null as string), 'why', 'unknown_class'))"
    return rows.selectExpr("motion_class", f"explode(if(policies is null, {none}, {known})) as g").select("motion_class", "g.*")


def measured_gates(reported: DataFrame, applicable: DataFrame) -> DataFrame:
    """A row for each strip and gate that applies to its class: outcome (pass, fail or undecidable), acceptance_outcome,
    metric, budget, hard_fail, numerator, denominator and reason; REVIEW counts as fail."""
    rows = reported.select("strip_id", "motion_class", "gates", "dimension_parity", "baseline_row_stable", "grounded", "displacement_pass", "caveats")
    rows = rows.join(F.broadcast(applicable.filter("gate is not null")), "motion_class").alias("measured").withColumn("g", F.expr("get(filter(gates, x -> x.gate = measured.gate), 0)"))
    outcome = """case when g is not null then if(g.outcome = 'PASS', 'pass', 'fail') when gate = 'dimension_parity' then if(dimension_parity, 'pass', 'fail')
        when gate = 'baseline_row_stable' and baseline_row_stable is not null then if(baseline_row_stable, 'pass', 'fail') when gate = 'displacement_pass' and displacement_pass is not null then if(displacement_pass, 'pass', 'fail') else 'undecidable' end"""
    return rows.selectExpr("strip_id", "motion_class", "ordinal", "gate", "why", f"{outcome} as outcome", "g.outcome as acceptance_outcome", "g.metric as metric", "g.budget as budget", "g.hard_fail as hard_fail",
                           "g.numerator as numerator", "g.denominator as denominator", "if(g is null and gate = 'displacement_pass', get(caveats, 0), null) as reason")
