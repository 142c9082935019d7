"""Queries of the frame metrics and gates, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coherence, gates, pairs
from ..sources import testdata as T
from ..sources.shared import cut

PAIR_SQL = """adj AS (SELECT a.*, i AS a, (i + 1) % n AS b FROM anchors a, range(16) t(i) WHERE i < n AND (i < n - 1 OR (loops AND n > 1))),
allp AS (SELECT s.*, i AS a, j AS b FROM anchors s, range(16) t(i), range(16) u(j) WHERE i < n AND j < n AND i <> j)"""


def _scores(name: str, source: str, sx: int, sy: int = 0) -> str:
    return f"""{name} AS (SELECT strip_id, a, b, dx, dy, sum(bit_count(xor(ma, mb))) AS changed, sum(bit_count(ma | mb)) AS un FROM (
  SELECT p.strip_id, p.a, p.b, dx, dy, l.m AS ma, CASE WHEN dx >= 0 THEN coalesce(r.m, 0) >> dx ELSE (coalesce(r.m, 0) << (-dx)) & 255 END AS mb
  FROM {source} p JOIN dense l ON l.strip_id = p.strip_id AND l.frame = p.a AND l.y < p.anchor
  CROSS JOIN (SELECT CAST(x AS INT) AS dx FROM range({-sx}, {sx + 1}) q(x)) CROSS JOIN (SELECT CAST(y AS INT) AS dy FROM range({-sy}, {sy + 1}) q(y))
  LEFT JOIN dense r ON r.strip_id = p.strip_id AND r.frame = p.b AND r.y = l.y + dy) GROUP BY ALL),
{name}_best AS (SELECT *, CASE WHEN un = 0 THEN 0.0 ELSE changed / un END AS frac, row_number() OVER (PARTITION BY strip_id, a, b ORDER BY CASE WHEN un = 0 THEN 0.0 ELSE changed / un END, dy, dx) AS r FROM {name})"""


BASE = f"WITH {T.CELLS}, {PAIR_SQL}"
DRIFT = """hist AS (SELECT *, CAST(sum(n) OVER (PARTITION BY strip_id, frame) AS BIGINT) AS total FROM (SELECT strip_id, frame, rgb, count(*) AS n FROM cells GROUP BY ALL)),
wrapped AS (SELECT strip_id, i AS a, (i + 1) % n AS b FROM strips, range(16) t(i) WHERE i < n AND n > 1),
tvs AS (SELECT strip_id, a, b, sum(abs(x * nb - y * na)) AS distance, max(2 * na * nb) AS whole FROM (
  SELECT w.strip_id, w.a, w.b, k.rgb, coalesce(l.n, 0) AS x, coalesce(r.n, 0) AS y, greatest(1, (SELECT coalesce(max(total), 0) FROM hist h WHERE h.strip_id = w.strip_id AND h.frame = w.a)) AS na,
    greatest(1, (SELECT coalesce(max(total), 0) FROM hist h WHERE h.strip_id = w.strip_id AND h.frame = w.b)) AS nb
  FROM wrapped w JOIN (SELECT DISTINCT strip_id, frame, rgb FROM hist) k ON k.strip_id = w.strip_id AND k.frame IN (w.a, w.b)
  LEFT JOIN hist l ON l.strip_id = w.strip_id AND l.frame = w.a AND l.rgb = k.rgb LEFT JOIN hist r ON r.strip_id = w.strip_id AND r.frame = w.b AND r.rgb = k.rgb
  GROUP BY ALL) GROUP BY ALL)"""


class Frames:
    """The tables that these queries share; masks are built once and read by every metric."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.cells, self.frames = T.cells(spark, sf_dir), T.frames(spark, sf_dir)
        self.masks = pairs.masks(self.cells, self.frames)
        self.strips = pairs.anchors(self.cells, self.frames, T.classes(spark))


def _int(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def src_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.cells(spark, sf_dir)


def src_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.frames(spark, sf_dir)


def join_shift1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Frames(spark, sf_dir)
    best = pairs.best_shift(pairs.shift_scores(pairs.adjacent(t.strips), t.masks, 1))
    return _int(best, "a", "b", "changed", "union").select("strip_id", "a", "b", "dx", "changed", F.col("union").alias("un"), "frac")


def join_shift2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Frames(spark, sf_dir)
    best = pairs.best_shift(pairs.shift_scores(pairs.adjacent(t.strips), t.masks, 4, 4))
    return _int(best, "a", "b", "changed", "union").select("strip_id", "a", "b", "dx", "dy", "changed", F.col("union").alias("un"))


win_best = join_shift2d


def join_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _int(pairs.adjacent(Frames(spark, sf_dir).strips), "a", "b").select("strip_id", "motion_class", "a", "b")


def join_allpairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _int(pairs.all_pairs(Frames(spark, sf_dir).strips), "a", "b").select("strip_id", "a", "b")


def agg_sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Frames(spark, sf_dir)
    return _int(pairs.worst_pair(pairs.shift_scores(pairs.adjacent(t.strips), t.masks, 4, 4)), "worst_a")


def agg_displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every strip is scanned here as if its class had a floor of 0.015, since few random strips are sharp."""
    t = Frames(spark, sf_dir)
    best = pairs.best_shift(pairs.shift_scores(pairs.adjacent(t.strips), t.masks, 4, 4))
    rows = pairs.displacement(t.strips, best)
    state = F.when(F.col("margin") < 0.015, "undecidable").when(F.size("flags") > 0, "fail").otherwise("pass")
    return rows.select("strip_id", F.size("flags").cast("long").alias("flags"), state.alias("displacement"))


def agg_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Frames(spark, sf_dir)
    return gates.silhouettes(t.strips, t.masks)


def agg_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Frames(spark, sf_dir)
    return gates.static_silhouette(t.strips, t.masks)


def agg_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.dimension_parity(T.frames(spark, sf_dir))


def agg_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Frames(spark, sf_dir)
    return gates.baseline_stability(pairs.baselines(t.cells, t.frames), t.strips)


def agg_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = gates.histograms(T.cells(spark, sf_dir))
    return h.groupBy("strip_id", "frame").agg(F.count("*").alias("colours"), F.max("n").alias("most"), F.max("total").alias("total"), F.array_join(F.array_sort(F.collect_set("rgb")), ",").alias("palette"))


def agg_tv(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Frames(spark, sf_dir)
    return _int(gates.palette_drift(t.strips, gates.histograms(t.cells)), "a", "b", "distance", "whole").drop("tv")


def report_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """cells and frames of the reports: frame 3 of every thirteenth strip is a row shorter, and frame 0 of some is empty."""
    short, empty = F.expr("strip_id % 13 = 5 and frame = 3"), F.expr("strip_id % 29 = 7 and frame = 0")
    frames = T.frames(spark, sf_dir).withColumn("h", F.when(short, T.H - 1).otherwise(F.col("h")))
    return T.cells(spark, sf_dir).filter(~(short & (F.col("y") == T.H - 1)) & ~empty), frames


COHORT_GATES = {"silhouette_budget": "adjacent_max", "loop_closure_pass": "loop.frac", "palette_drift_pass": "worst_drift", "min_pair_cohort_pass": "min_pair", "static_silhouette_pass": "static_max"}


def profiles(spark: SparkSession, registered: DataFrame) -> DataFrame:
    """Profiles from the cohort itself: budget and hard_fail are the lower and upper tercile of each class and gate.

    One class has no profile, one no loop gate, one gate no budget and one is not applicable.
    """
    stack = ", ".join(f"'{g}', {m}" for g, m in COHORT_GATES.items())
    rows = registered.selectExpr("motion_class", f"stack({len(COHORT_GATES)}, {stack}) as (gate, metric)").filter("motion_class <> 'emissive' and (motion_class <> 'blob_idle' or gate <> 'loop_closure_pass')")
    budgets = rows.groupBy("motion_class", "gate").agg(*(F.expr(f"percentile_disc({p}) within group (order by metric) / 10000D").alias(n) for n, p in (("budget", 0.33), ("hard_fail", 0.66))))
    status = "case when gate = 'min_pair_cohort_pass' then 'UNSEPARATED' when motion_class = 'walk' and gate = 'static_silhouette_pass' then 'INAPPLICABLE' else 'SEPARATED' end as status"
    budgets = budgets.selectExpr("motion_class", "gate", status, "if(motion_class = 'swing' and gate = 'palette_drift_pass', null, budget) as budget", "hard_fail")
    more = [("airborne", "displacement_pass", "SEPARATED"), *((c, "baseline_row_stable", "SEPARATED") for c in ("idle", "blob_idle", "swing"))]
    return budgets.unionByName(spark.createDataFrame(more, "motion_class string, gate string, status string"), allowMissingColumns=True)


class Reports:
    """The registered strips, written once; their profiles and their reports."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.registered = cut(coherence.registration(*report_tables(spark, sf_dir), T.classes(spark)), "registered")
        self.profiles = profiles(spark, self.registered)
        self.reports = coherence.reports(self.registered, self.profiles)


def agg_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of each strip; its arrays as text."""
    join = "array_join(transform({}, x -> {}), ' ') as {}".format
    pair = "concat(x.a, '-', x.b, ':', x.changed, '/', x.union)"
    return Reports(spark, sf_dir).reports.selectExpr(
        "strip_id", "motion_class", "dimension_parity", "baseline_row_stable", join("baselines", "coalesce(cast(x as string), '-')", "baselines"), join("adjacent", pair, "adjacent"), join("still", pair, "still"),
        "concat(loop.changed, '/', loop.union) as loop", "adjacent_max", "max_pair", "min_pair", "orphan_max", "static_max", "colours", join("palette", "x", "palette"), join("drift", "concat(x.a, '-', x.b, ':', x.tv)", "drift"),
        "worst_drift", "margin", "displacement_pass", join("gates", "concat(x.gate, ':', x.status, ':', cast(round(x.metric * 10000) as bigint), ':', x.outcome, ':', coalesce(x.reason, ''), ':', coalesce(concat(x.numerator, '/', x.denominator), ''))", "gates"),
        "array_join(caveats, ' ') as caveats", "structural_fail", "reason_code", "outcome",
    )


def agg_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of each strip, and of the bundle that holds it with four more checks."""
    rows = Reports(spark, sf_dir).reports.selectExpr(
        "strip_id", "structural_fail", "size(filter(gates, g -> g.outcome = 'FAIL')) as fails", "size(filter(gates, g -> g.outcome = 'REVIEW')) as reviews", "outcome as coherence",
        "case strip_id % 7 when 0 then 'FAIL' when 1 then 'PASS' when 2 then 'REVIEW' end as post_edit", "case strip_id % 5 when 0 then 'FAIL' when 1 then 'PASS' end as identity",
        "case strip_id % 11 when 0 then 'FAIL' when 1 then null else 'PASS' end as structural", "case strip_id % 3 when 0 then 'REVIEW' else 'PASS' end as provider")
    return coherence.bundle_outcomes(rows).selectExpr("strip_id", "structural_fail", "cast(fails as bigint) as fails", "cast(reviews as bigint) as reviews", "coherence", "outcome as bundle", "decided_by")


def agg_unsep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Reports(spark, sf_dir).reports.select("strip_id", "lenient_outcome")


def strip_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least slice end to end: silhouette change between neighbours against fixed budgets."""
    from ..functions.scalars import canonical, tristate

    t = Frames(spark, sf_dir)
    best = pairs.best_shift(pairs.shift_scores(pairs.adjacent(t.strips), t.masks, 1))
    metric = best.groupBy("strip_id").agg(F.max("frac").alias("metric")).join(t.strips.select("strip_id", "motion_class"), "strip_id")
    outcome = tristate("metric", F.lit("SEPARATED"), F.lit(0.5), F.lit(0.6))
    return metric.select("strip_id", "motion_class", canonical("metric").alias("metric"), F.lit(0.5).alias("budget"), F.lit(0.6).alias("hard_fail"), outcome.alias("outcome"))


def run_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate rows of runs: a strip's gates, its target the one of its number among those that can be one."""
    r = Reports(spark, sf_dir)
    rows = coherence.measured_gates(r.reports, coherence.applicable_gates(T.classes(spark), r.profiles))
    target = "filter(array('silhouette_budget', if(loops and motion_class <> 'blob_idle', 'loop_closure_pass', null), if(motion_class = 'airborne', 'displacement_pass', null), 'palette_drift_pass'), t -> t is not null)"
    rows = rows.join(F.broadcast(T.classes(spark).select("motion_class", "loops")), "motion_class").selectExpr("*", f"{target} as targets")
    return rows.selectExpr("strip_id as run_id", "gate", "why", "targets[cast(strip_id % size(targets) as int)] as target_gate", "outcome", "acceptance_outcome", "metric", "budget", "hard_fail", "numerator", "denominator", "reason")


def agg_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.isolation(run_gates(spark, sf_dir)).drop("code", "failed_gate", "metric_now", "budget_now")


def fn_primary_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.isolation(run_gates(spark, sf_dir)).select("run_id", "code", "failed_gate")


def fn_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = gates.retry_actions(gates.isolation(run_gates(spark, sf_dir)).filter("code is not null"))
    return actions.select("run_id", "code", "intent", "direction", "metric_now", "must_exceed", "must_fall_below")


def fn_gate_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_gates(spark, sf_dir)


def fn_applicable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates that apply to each strip, in order, and why."""
    r = Reports(spark, sf_dir)
    return r.registered.select("strip_id", "motion_class").join(F.broadcast(coherence.applicable_gates(T.classes(spark), r.profiles)), "motion_class").select("strip_id", "ordinal", "gate", "why")


SIL = f"""{BASE}, {_scores("s1", "adj", 1)}, {_scores("sa", "allp", 1)},
sil AS (SELECT a.strip_id, x.adjacent_max, x.loop, y.max_pair, y.min_pair, z.orphan_max FROM anchors a
  LEFT JOIN (SELECT strip_id, max(CASE WHEN b > 0 THEN frac END) AS adjacent_max, max(CASE WHEN b = 0 THEN frac END) AS loop FROM s1_best WHERE r = 1 GROUP BY 1) x USING (strip_id)
  LEFT JOIN (SELECT strip_id, max(frac) AS max_pair, min(frac) AS min_pair FROM sa_best WHERE r = 1 AND a < b GROUP BY 1) y USING (strip_id)
  LEFT JOIN (SELECT strip_id, max(near) AS orphan_max FROM (SELECT strip_id, a, min(frac) AS near FROM sa_best WHERE r = 1 GROUP BY ALL) GROUP BY 1) z USING (strip_id)) """


def _r4(num: str, den: str) -> str:
    """num / den in whole ten-thousandths, half to even."""
    whole, rest = f"(CAST({num} AS BIGINT) * 10000 // CAST({den} AS BIGINT))", f"(2 * (CAST({num} AS BIGINT) * 10000 % CAST({den} AS BIGINT)))"
    return f"CASE WHEN ({den}) = 0 THEN 0 ELSE {whole} + CASE WHEN {rest} > ({den}) OR ({rest} = ({den}) AND {whole} % 2 = 1) THEN 1 ELSE 0 END END"


UNEVEN = T.CELLS.replace("FROM e WHERE v > 0)", "FROM e WHERE v > 0 AND NOT (vec_id // 4 % 13 = 5 AND vec_id % 4 = 3 AND pos >= 56) AND NOT (vec_id // 4 % 29 = 7 AND vec_id % 4 = 0))").replace(
    f"{T.W} AS w, {T.H} AS h, motion_class", f"{T.W} AS w, CASE WHEN vec_id // 4 % 13 = 5 AND vec_id % 4 = 3 THEN {T.H - 1} ELSE {T.H} END AS h, motion_class")
_ANCHOR = "least(f.h, g.h, CASE WHEN grounded THEN coalesce(anchor_row, p.baseline, f.h) ELSE h0 END)"
REPORT = f"""WITH {UNEVEN},
st AS (SELECT s.strip_id, s.motion_class, n, grounded, loops, min_sharpness, z.h AS h0, CASE WHEN grounded THEN b.baseline END AS anchor_row FROM strips s JOIN classes USING (motion_class)
  JOIN base b ON b.strip_id = s.strip_id AND b.frame = 0 JOIN frames z ON z.strip_id = s.strip_id AND z.frame = 0),
pr AS (SELECT st.strip_id, f.frame AS a, g.frame AS b, {_ANCHOR} AS anchor, least(f.h, g.h) AS both_h, n, min_sharpness, loops FROM st JOIN frames f USING (strip_id) JOIN frames g ON g.strip_id = st.strip_id AND g.frame <> f.frame
  JOIN base p ON p.strip_id = st.strip_id AND p.frame = f.frame),
ring AS (SELECT * FROM pr WHERE min_sharpness IS NOT NULL AND b = (a + 1) % n AND (b > 0 OR loops)),
{_scores("sa", "pr", 1)}, {_scores("sw", "ring", 4, 4)},
reg AS (SELECT strip_id, a, b, changed, un, {_r4("changed", "un")} AS f4 FROM sa_best WHERE r = 1),
quiet AS (SELECT strip_id, a, b, changed, un, CASE WHEN un = 0 THEN 10000 ELSE {_r4("un - changed", "un")} END AS f4 FROM (SELECT p.strip_id, p.a, p.b, sum(bit_count(xor(l.m, r.m))) AS changed, sum(bit_count(l.m | r.m)) AS un
  FROM pr p JOIN dense l ON l.strip_id = p.strip_id AND l.frame = p.a AND l.y < p.both_h JOIN dense r ON r.strip_id = p.strip_id AND r.frame = p.b AND r.y = l.y WHERE p.b = p.a + 1 GROUP BY ALL)),
adjacents AS (SELECT strip_id, string_agg(a || '-' || b || ':' || changed || '/' || un, ' ' ORDER BY a) AS adjacent, max(f4) AS adjacent_max, arg_min(changed || '/' || un, -f4 * 1000 + a) AS worst_of FROM reg WHERE b = a + 1 GROUP BY 1),
quiets AS (SELECT strip_id, string_agg(a || '-' || b || ':' || changed || '/' || un, ' ' ORDER BY a) AS still, max(f4) AS static_max FROM quiet GROUP BY 1),
loops_ AS (SELECT strip_id, reg.changed || '/' || reg.un AS loop, f4 AS loop4 FROM reg JOIN st USING (strip_id) WHERE b = 0 AND a = n - 1),
uppers AS (SELECT strip_id, max(f4) AS max_pair, min(f4) AS min_pair FROM reg WHERE a < b GROUP BY 1),
orphans AS (SELECT strip_id, max(near) AS orphan_max FROM (SELECT strip_id, a, min(f4) AS near FROM reg GROUP BY ALL) GROUP BY 1),
cc AS (SELECT strip_id, frame, rgb, count(*) AS n, min(frame * 10000 + y * 100 + x) AS seen FROM cells GROUP BY ALL), co AS (SELECT strip_id, rgb, sum(n)::BIGINT AS n, min(seen) AS seen FROM cc GROUP BY ALL),
ld AS (SELECT strip_id, count(*) AS colours, list_reduce(list_transform(list_sort(list({{'m': -n, 'seen': seen, 'rgb': rgb}})), lambda c: [c]), lambda acc, c: CASE WHEN len(list_filter(acc, lambda k: ((k.rgb >> 16) - (c[1].rgb >> 16)) ** 2 <= 4096)) > 0 THEN acc ELSE list_concat(acc, c) END) AS leaders FROM co GROUP BY 1),
lr AS (SELECT strip_id, generate_subscripts(leaders, 1) AS place, unnest(leaders).rgb AS leader FROM ld),
cl AS (SELECT strip_id, co.rgb, co.n, min(place) AS place FROM co JOIN lr USING (strip_id) WHERE ((co.rgb >> 16) - (leader >> 16)) ** 2 <= 4096 GROUP BY ALL),
pal AS (SELECT strip_id, leader AS rgb, row_number() OVER (PARTITION BY strip_id ORDER BY sum(n) DESC, leader) - 1 AS ord FROM cl JOIN lr USING (strip_id, place) GROUP BY strip_id, leader QUALIFY ord < 16),
pals AS (SELECT strip_id, string_agg(rgb, ' ' ORDER BY ord) AS palette FROM pal GROUP BY 1),
qq AS (SELECT cc.strip_id, frame, n, arg_min(pal.rgb, ((cc.rgb >> 16) - (pal.rgb >> 16)) ** 2 * 100 + ord) AS rgb FROM cc JOIN pal USING (strip_id) GROUP BY cc.strip_id, frame, cc.rgb, n),
hist AS (SELECT *, CAST(sum(n) OVER (PARTITION BY strip_id, frame) AS BIGINT) AS total FROM (SELECT strip_id, frame, rgb, sum(n)::BIGINT AS n FROM qq GROUP BY ALL)),
wrapped{DRIFT.split(",\nwrapped")[1]},
drifts AS (SELECT strip_id, string_agg(a || '-' || b || ':' || tv, ' ' ORDER BY a) AS drift, max(tv) AS worst_drift FROM (SELECT strip_id, a, b, {_r4("distance", "whole")} AS tv FROM tvs) GROUP BY 1),
sharp AS (SELECT strip_id, min(mg) AS margin, arg_min(a || '→' || b, mg * 1000 + a) AS worst_pair FROM (SELECT strip_id, a, b, {_r4("c2 * greatest(u1, 1) - c1 * greatest(u2, 1)", "greatest(u1, 1) * greatest(u2, 1)")} AS mg
  FROM (SELECT strip_id, a, b, max(changed) FILTER (r = 1) AS c1, max(un) FILTER (r = 1) AS u1, max(changed) FILTER (r = 2) AS c2, max(un) FILTER (r = 2) AS u2 FROM sw_best GROUP BY ALL)) GROUP BY 1),
flagged AS (SELECT x.strip_id, count(*) AS flags FROM sw_best x JOIN sw_best y ON x.strip_id = y.strip_id AND x.b = y.a AND x.r = 1 AND y.r = 1 JOIN st s ON s.strip_id = x.strip_id
  WHERE n >= 3 AND (loops OR (x.b > 0 AND x.b < n - 1)) AND greatest(abs(x.dx), abs(x.dy)) >= 2 AND greatest(abs(x.dx + y.dx), abs(x.dy + y.dy)) <= 1 GROUP BY 1),
frs AS (SELECT strip_id, count(DISTINCT (w, h)) = 1 AS dimension_parity, string_agg(coalesce(CAST(baseline AS VARCHAR), '-'), ' ' ORDER BY frame) AS baselines, bool_and(baseline IS NOT DISTINCT FROM anchor_row) AS same FROM frames JOIN base USING (strip_id, frame) JOIN st USING (strip_id) GROUP BY 1),
w AS (SELECT st.*, dimension_parity, baselines, CASE WHEN grounded THEN same END AS baseline_row_stable, adjacent, adjacent_max, worst_of, still, static_max, loop, loop4, max_pair, min_pair, orphan_max, colours, palette, drift, worst_drift, margin, worst_pair,
  CASE WHEN margin IS NULL OR margin < min_sharpness * 10000 THEN NULL ELSE flags IS NULL END AS displacement_pass FROM st JOIN frs USING (strip_id) LEFT JOIN adjacents USING (strip_id) LEFT JOIN quiets USING (strip_id) LEFT JOIN loops_ USING (strip_id)
  LEFT JOIN uppers USING (strip_id) LEFT JOIN orphans USING (strip_id) LEFT JOIN ld USING (strip_id) LEFT JOIN pals USING (strip_id) LEFT JOIN drifts USING (strip_id) LEFT JOIN sharp USING (strip_id) LEFT JOIN flagged USING (strip_id)),
long AS (SELECT strip_id, motion_class, o, gate, m, ev FROM (SELECT strip_id, motion_class, 1 AS o, 'silhouette_budget' AS gate, adjacent_max AS m, worst_of AS ev FROM w UNION ALL SELECT strip_id, motion_class, 2, 'loop_closure_pass', loop4, loop FROM w UNION ALL SELECT strip_id, motion_class, 3, 'palette_drift_pass', worst_drift, NULL FROM w
  UNION ALL SELECT strip_id, motion_class, 4, 'min_pair_cohort_pass', min_pair, NULL FROM w UNION ALL SELECT strip_id, motion_class, 5, 'static_silhouette_pass', static_max, NULL FROM w) WHERE m IS NOT NULL),
profiles AS (SELECT motion_class, gate, CASE WHEN gate = 'min_pair_cohort_pass' THEN 'UNSEPARATED' WHEN motion_class = 'walk' AND gate = 'static_silhouette_pass' THEN 'INAPPLICABLE' ELSE 'SEPARATED' END AS status,
  CASE WHEN motion_class <> 'swing' OR gate <> 'palette_drift_pass' THEN low / 10000 END AS budget, high / 10000 AS hard_fail FROM (SELECT motion_class, gate, quantile_disc(m, 0.33) AS low, quantile_disc(m, 0.66) AS high FROM long WHERE motion_class <> 'emissive' AND (motion_class <> 'blob_idle' OR gate <> 'loop_closure_pass') GROUP BY ALL)),
outcomes AS (SELECT strip_id, motion_class, o, gate, status, m, budget, CASE WHEN status = 'SEPARATED' THEN hard_fail END AS hard_fail, ev, CASE WHEN budget IS NULL THEN 'missing_budget' END AS reason,
  CASE WHEN budget IS NULL THEN 'FAIL' WHEN m / 10000 <= budget THEN 'PASS' WHEN status = 'SEPARATED' AND m / 10000 >= hard_fail THEN 'FAIL' ELSE 'REVIEW' END AS outcome FROM long JOIN profiles USING (motion_class, gate) WHERE status <> 'INAPPLICABLE'
  UNION ALL SELECT strip_id, motion_class, 6, 'displacement_pass', 'SEPARATED', CASE WHEN displacement_pass THEN 10000 ELSE 0 END, NULL, NULL, NULL, NULL, CASE WHEN displacement_pass THEN 'PASS' ELSE 'REVIEW' END FROM w WHERE motion_class = 'airborne' AND displacement_pass IS NOT NULL),
listed AS (SELECT strip_id, string_agg(gate || ':' || status || ':' || m || ':' || outcome || ':' || coalesce(reason, '') || ':' || coalesce(ev, ''), ' ' ORDER BY o) AS gates, count(*) FILTER (outcome = 'FAIL') AS fails, count(*) FILTER (outcome = 'REVIEW') AS reviews, count(*) FILTER (outcome = 'REVIEW' AND status <> 'UNSEPARATED') AS hard FROM outcomes GROUP BY 1),
rep AS (SELECT w.*, coalesce(gates, '') AS gates, coalesce(fails, 0) AS fails, coalesce(reviews, 0) AS reviews, coalesce(hard, 0) AS hard, NOT dimension_parity OR (baseline_row_stable IS NOT DISTINCT FROM false) AS structural_fail, CASE WHEN motion_class = 'emissive' THEN 'missing_profile' END AS reason_code,
  CASE WHEN motion_class = 'airborne' AND margin < min_sharpness * 10000 THEN 'degenerate alignment minimum (margin ' || printf('%.4f', margin / 10000) || ' at ' || worst_pair || '); displacement undecidable' ELSE '' END AS caveats FROM w LEFT JOIN listed USING (strip_id)),
verdicts AS (SELECT *, CASE WHEN structural_fail OR reason_code IS NOT NULL OR fails > 0 THEN 'FAIL' WHEN reviews > 0 THEN 'REVIEW' ELSE 'PASS' END AS outcome, CASE WHEN structural_fail OR reason_code IS NOT NULL OR fails > 0 THEN 'FAIL' WHEN hard > 0 THEN 'REVIEW' ELSE 'PASS' END AS lenient_outcome FROM rep),
apply AS (SELECT c.motion_class, CAST(k.ordinal AS INT) AS ordinal, k.gate, CASE k.gate WHEN 'dimension_parity' THEN 'structural' WHEN 'palette_drift_pass' THEN 'always' WHEN 'baseline_row_stable' THEN CASE WHEN grounded AND c.motion_class <> 'walk' THEN 'grounded: true' END WHEN 'displacement_pass' THEN CASE WHEN NOT grounded THEN 'grounded: false' END
  WHEN 'silhouette_budget' THEN 'max_silhouette=' || p.budget WHEN 'loop_closure_pass' THEN CASE WHEN loops THEN 'max_loop=' || p.budget END ELSE CASE WHEN loops THEN 'max_min_pair=' || p.budget END END AS why
  FROM classes c CROSS JOIN (VALUES (0, 'dimension_parity'), (1, 'baseline_row_stable'), (2, 'silhouette_budget'), (3, 'displacement_pass'), (4, 'loop_closure_pass'), (5, 'min_pair_cohort_pass'), (6, 'palette_drift_pass')) k(ordinal, gate) LEFT JOIN profiles p ON p.motion_class = c.motion_class AND p.gate = k.gate WHERE c.motion_class <> 'emissive'),
targets AS (SELECT strip_id, list_filter(['silhouette_budget', CASE WHEN loops AND motion_class <> 'blob_idle' THEN 'loop_closure_pass' END, CASE WHEN motion_class = 'airborne' THEN 'displacement_pass' END, 'palette_drift_pass'], lambda t: t IS NOT NULL) AS l FROM st),
runs AS (SELECT v.strip_id AS run_id, a.gate, a.why, l[v.strip_id % len(l) + 1] AS target_gate, CASE WHEN x.outcome IS NOT NULL THEN CASE WHEN x.outcome = 'PASS' THEN 'pass' ELSE 'fail' END WHEN a.gate = 'dimension_parity' THEN CASE WHEN dimension_parity THEN 'pass' ELSE 'fail' END
  WHEN a.gate = 'baseline_row_stable' AND baseline_row_stable IS NOT NULL THEN CASE WHEN baseline_row_stable THEN 'pass' ELSE 'fail' END ELSE 'undecidable' END AS outcome, x.outcome AS acceptance_outcome, x.m / 10000 AS metric, x.budget, x.hard_fail,
  CAST(split_part(ev, '/', 1) AS BIGINT) AS numerator, CAST(split_part(ev, '/', 2) AS BIGINT) AS denominator, CASE WHEN x.outcome IS NULL AND a.gate = 'displacement_pass' THEN caveats END AS reason
  FROM verdicts v JOIN apply a ON a.motion_class = v.motion_class AND a.why IS NOT NULL JOIN targets USING (strip_id) LEFT JOIN outcomes x ON x.strip_id = v.strip_id AND x.gate = a.gate),
iso AS (SELECT run_id, target_gate, max(outcome) FILTER (gate = target_gate) AS target, max(metric) FILTER (gate = target_gate) AS own_metric, max(budget) FILTER (gate = target_gate) AS own_budget, count(*) FILTER (gate <> target_gate AND outcome = 'fail') AS others,
  string_agg(gate, ',' ORDER BY gate) FILTER (gate <> target_gate AND outcome = 'fail') AS blockers, count(*) FILTER (gate <> target_gate AND outcome = 'undecidable') AS caveats,
  min_by({{'gate': gate, 'metric': metric, 'budget': budget}}, list_position(['dimension_parity','baseline_row_stable','silhouette_budget','displacement_pass','loop_closure_pass','min_pair_cohort_pass','palette_drift_pass'], gate)) FILTER (gate <> target_gate AND outcome = 'fail') AS first FROM runs GROUP BY ALL),
codes AS (SELECT *, CASE WHEN isolation = 'ISOLATED' THEN NULL WHEN target = 'undecidable' THEN 'GATE_UNDECIDABLE' WHEN target = 'pass' THEN 'TARGET_DEFECT_TOO_WEAK' ELSE 'COLLATERAL_GATE_FAILED' END AS code
  FROM (SELECT *, CASE WHEN target = 'undecidable' THEN 'INDETERMINATE' WHEN target = 'fail' AND others = 0 THEN 'ISOLATED' ELSE 'NOT_ISOLATED' END AS isolation FROM iso)),
failures AS (SELECT run_id, code, CASE WHEN code = 'COLLATERAL_GATE_FAILED' THEN first.gate WHEN code IS NOT NULL THEN target_gate END AS failed_gate, CASE WHEN code = 'COLLATERAL_GATE_FAILED' THEN first.metric ELSE own_metric END AS metric_now, CASE WHEN code = 'COLLATERAL_GATE_FAILED' THEN first.budget ELSE own_budget END AS budget_now FROM codes)
"""
PARTS = f"{BASE}, {_scores('s1', 'adj', 1)}, {_scores('s2', 'adj', 4, 4)}, {DRIFT} "
SHIFT2 = PARTS + "SELECT strip_id, a, b, dx, dy, changed, un FROM s2_best WHERE r = 1"
SQL = {
    "src_cells": f"WITH {T.CELLS} SELECT * FROM cells",
    "src_frames": f"WITH {T.CELLS} SELECT * FROM frames",
    "join_adjacent": BASE + " SELECT strip_id, motion_class, a, b FROM adj",
    "join_allpairs": BASE + " SELECT strip_id, a, b FROM allp WHERE a < b",
    "join_shift1d": PARTS + "SELECT strip_id, a, b, dx, changed, un, frac FROM s1_best WHERE r = 1",
    "join_shift2d": SHIFT2,
    "win_best": SHIFT2,
    "agg_sharpness": PARTS + "SELECT strip_id, min(margin) AS min_margin, arg_min(a, margin * 1000000 + a / 1000000.0) AS worst_a FROM (SELECT strip_id, a, max(frac) FILTER (r = 2) - max(frac) FILTER (r = 1) AS margin FROM s2_best WHERE r <= 2 GROUP BY strip_id, a, b) GROUP BY 1",
    "agg_displacement": PARTS + """, best AS (SELECT * FROM s2_best WHERE r = 1), sharp AS (SELECT strip_id, min(margin) AS margin FROM (SELECT strip_id, max(frac) FILTER (r = 2) - max(frac) FILTER (r = 1) AS margin FROM s2_best WHERE r <= 2 GROUP BY strip_id, a, b) GROUP BY 1),
flags AS (SELECT x.strip_id, count(*) AS flags FROM best x JOIN best y ON x.strip_id = y.strip_id AND x.b = y.a JOIN anchors s ON s.strip_id = x.strip_id
  WHERE n >= 3 AND (loops OR (x.b > 0 AND x.b < n - 1)) AND greatest(abs(x.dx), abs(x.dy)) >= 2 AND greatest(abs(x.dx + y.dx), abs(x.dy + y.dy)) <= 1 GROUP BY 1)
SELECT s.strip_id, coalesce(flags, 0) AS flags, CASE WHEN margin < 0.015 THEN 'undecidable' WHEN flags > 0 THEN 'fail' ELSE 'pass' END AS displacement FROM sharp s LEFT JOIN flags f USING (strip_id)""",
    "agg_silhouette": SIL + "SELECT * FROM sil",
    "agg_static": BASE + """, p AS (SELECT strip_id, a, b, 1000000 AS anchor FROM adj WHERE b > 0 UNION SELECT strip_id, i, i + 1, 1000000 FROM strips, range(16) t(i) WHERE i < n - 1),
x AS (SELECT p.strip_id, a, b, sum(bit_count(xor(l.m, r.m))) AS changed, sum(bit_count(l.m | r.m)) AS un FROM p JOIN dense l ON l.strip_id = p.strip_id AND l.frame = a JOIN dense r ON r.strip_id = p.strip_id AND r.frame = b AND r.y = l.y GROUP BY ALL)
SELECT strip_id, max(CASE WHEN un = 0 THEN 1.0 ELSE 1.0 - changed / un END) AS static FROM x GROUP BY 1""",
    "agg_dims": f"WITH {T.CELLS} SELECT strip_id, count(DISTINCT (w, h)) = 1 AS dimension_parity FROM frames GROUP BY 1",
    "agg_baseline": f"WITH {T.CELLS} SELECT a.strip_id, CASE WHEN grounded THEN bool_and(b.baseline IS NOT DISTINCT FROM z.baseline) END AS baseline_row_stable FROM anchors a JOIN base b USING (strip_id) JOIN base z ON z.strip_id = a.strip_id AND z.frame = 0 GROUP BY a.strip_id, grounded",
    "agg_palette": f"WITH {T.CELLS}, {DRIFT.split(',' + chr(10) + 'wrapped')[0]} SELECT strip_id, frame, count(*) AS colours, max(n) AS most, max(total) AS total, string_agg(CAST(rgb AS VARCHAR), ',' ORDER BY rgb) AS palette FROM hist GROUP BY ALL",
    "agg_tv": PARTS + "SELECT * FROM tvs",
    "agg_coherence": REPORT + """SELECT strip_id, motion_class, dimension_parity, baseline_row_stable, baselines, adjacent, still, loop, adjacent_max, max_pair, min_pair, orphan_max, static_max, colours, palette, drift, worst_drift, margin, displacement_pass, gates, caveats, structural_fail, reason_code, outcome FROM verdicts""",
    "agg_outcome": REPORT + """, b AS (SELECT strip_id, structural_fail, fails, reviews, outcome AS coherence, CASE strip_id % 7 WHEN 0 THEN 'FAIL' WHEN 1 THEN 'PASS' WHEN 2 THEN 'REVIEW' END AS post_edit, CASE strip_id % 5 WHEN 0 THEN 'FAIL' WHEN 1 THEN 'PASS' END AS identity,
  CASE strip_id % 11 WHEN 0 THEN 'FAIL' WHEN 1 THEN NULL ELSE 'PASS' END AS structural, CASE strip_id % 3 WHEN 0 THEN 'REVIEW' ELSE 'PASS' END AS provider FROM verdicts),
d AS (SELECT *, CASE WHEN post_edit = 'FAIL' THEN 'post_edit' WHEN identity = 'FAIL' THEN 'identity' WHEN structural IS NULL OR structural = 'FAIL' THEN 'structural' WHEN provider = 'REVIEW' THEN 'provider' WHEN post_edit = 'REVIEW' THEN 'post_edit' ELSE 'coherence' END AS decided_by FROM b)
SELECT strip_id, structural_fail, fails, reviews, coherence, CASE decided_by WHEN 'provider' THEN 'REVIEW' WHEN 'coherence' THEN coherence ELSE 'FAIL' END AS bundle, decided_by FROM d""",
    "agg_unsep": REPORT + "SELECT strip_id, lenient_outcome FROM verdicts",
    "strip_outcome": PARTS + """SELECT strip_id, motion_class, m AS metric, 0.5::DOUBLE AS budget, 0.6::DOUBLE AS hard_fail, CASE WHEN m <= 0.5 THEN 'PASS' WHEN m >= 0.6 THEN 'FAIL' ELSE 'REVIEW' END AS outcome
FROM (SELECT strip_id, ceil(CAST(max(frac) AS DECIMAL(20,16)) * 10000)::DOUBLE / 10000 AS m FROM s1_best WHERE r = 1 GROUP BY 1) JOIN strips USING (strip_id)""",
    "agg_isolation": REPORT + "SELECT run_id, target_gate, isolation, coalesce(blockers, '') AS blockers, caveats FROM codes",
    "fn_primary_failure": REPORT + "SELECT run_id, code, failed_gate FROM failures",
    "fn_retry": REPORT + """SELECT run_id, code, CASE code WHEN 'GATE_UNDECIDABLE' THEN 'change the motion so alignment is well-posed' WHEN 'TARGET_DEFECT_TOO_WEAK' THEN 'amplify the targeted defect' ELSE 'hold the collateral dimension fixed' END AS intent,
CASE code WHEN 'TARGET_DEFECT_TOO_WEAK' THEN 'increase' WHEN 'COLLATERAL_GATE_FAILED' THEN 'decrease' END AS direction, metric_now, CASE WHEN code = 'TARGET_DEFECT_TOO_WEAK' THEN budget_now END AS must_exceed, CASE WHEN code = 'COLLATERAL_GATE_FAILED' THEN budget_now END AS must_fall_below FROM failures WHERE code IS NOT NULL""",
    "fn_gate_row": REPORT + "SELECT * FROM runs",
    "fn_applicable": REPORT + """SELECT strip_id, ordinal, gate, why FROM strips JOIN apply USING (motion_class) WHERE why IS NOT NULL UNION ALL SELECT strip_id, 0, NULL, 'unknown_class' FROM strips WHERE motion_class = 'emissive'""",
}
QUERIES = {n: globals()[n] for n in SQL}
