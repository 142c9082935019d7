"""Queries of review, controls, packs, attestation and rescoring, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import tristate
from ..operators import controls, evidence, gates, grid, ledger, packs, review
from ..sources import testdata as T
from .q_evidence import contract_tables
from .q_frames import _scores
from .q_records import _rules


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return T.table(spark, sf_dir, name)


def join_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as bundles of a source; those of every tenth are on the list of legacy bundles."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("specification_id"), F.sha2("text", 256).alias("provider_sha256"))
    return evidence.allow_listed(d, d.filter("doc_id % 10 = 0")).select("doc_id")


def join_attestation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as specifications whose turns are attempts; bundles carry ledgers of which some were changed."""
    c, conv = _t(spark, sf_dir, "conversations"), F.col("conv_id")
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    store = c.select(
        conv.alias("specification_id"), F.col("turn").alias("ord"), F.concat_ws("-", conv, "turn").alias("attempt_id"), F.when(before.isNotNull(), F.concat_ws("-", conv, before)).alias("predecessor_attempt_id"),
        F.when(F.col("role") == "user", "REJECTED").otherwise("SELECTED").alias("outcome"), F.col("role").alias("rejection_reason"), F.sha2("text", 256).alias("prompt_sha256"), F.sha2("role", 256).alias("raw_sha256"),
    )
    chosen = conv % 4
    bundles = c.select(conv.alias("bundle_id"), conv.alias("specification_id"), F.sha2(conv.cast("string"), 256).alias("provider_sha256"), F.concat_ws("-", conv, chosen).alias("attempt_id"), (conv % 13 == 0).alias("cell_authored")).distinct()
    own, at = store.withColumn("bundle_id", F.col("specification_id")), F.col("bundle_id") % 4
    committed = own.filter(F.col("ord") <= at).filter((F.col("bundle_id") % 5 != 0) | (F.col("ord") > 0)).withColumn("selected", (F.col("ord") == at) & (F.col("bundle_id") % 7 != 0))
    return ledger.attestation(bundles, committed, store, bundles.filter("bundle_id % 11 = 0"))


LABELS = ("provider", "provenance", "attempt_ledger", "identity_reference", "edit_source")


def join_evidence_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as bundles with five bound files; some are not bound, missing, changed or lie elsewhere."""
    d, i = _t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha")), F.col("doc_id")
    path = lambda x: F.when(i % (13 + len(x)) == 0, "a/../b").otherwise(F.concat(F.lit(f"{x}/"), i))
    bound = [F.when(i % (len(x) - 3) != 0, path(x)).alias(f"{x}_path") for x in LABELS]
    shas = [F.when(i % (11 + 2 * k) == 0, F.reverse("sha")).otherwise(F.col("sha")).alias(f"{x}_sha") for k, x in enumerate(LABELS)]
    files = d.select("doc_id", "sha", F.explode(F.array(*(F.lit(x) for x in LABELS))).alias("label")).filter("doc_id % 17 <> 3").select(F.concat_ws("/", "label", "doc_id").alias("path"), F.col("sha").alias("actual"))
    return evidence.evidence_bindings(d.select(i.alias("bundle_id"), *bound, *shas), files, LABELS, LABELS[:3])


def join_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets of brands (classes) and types (gates) of parts from their promoted controls."""
    part, k = _t(spark, sf_dir, "part"), F.col("k")
    pairs = part.groupBy(F.col("p_brand").alias("motion_class"), F.col("p_type").alias("gate")).agg(F.min("p_partkey").alias("k"))
    status = F.when(k % 4 == 0, "UNSEPARATED").when(k % 9 == 0, "INAPPLICABLE").otherwise("SEPARATED")
    profiles = pairs.select("motion_class", "gate", "k", status.alias("status"), F.when(k % 19 != 0, F.lit(0.25)).alias("budget"), F.when(k % 5 != 0, F.concat(F.lit("p"), k)).alias("active_promotion"))
    promotions = pairs.filter("k % 7 <> 0").select(F.concat(F.lit("p"), k).alias("id"), F.concat(F.lit("a"), k).alias("attempt_id"), F.concat(F.lit("m"), k).alias("measurement_path"), F.when(k % 11 == 0, "INVALIDATED").otherwise("ACTIVE").alias("status"))
    runs = pairs.select(F.concat(F.lit("m"), k).alias("path"), "gate", F.when(k % 13 != 0, (k * 37 % 64).cast("double") / 64).alias("metric"), F.array(F.lit("c")).alias("caveats"))
    lines = _t(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    worst = evidence.worst_good(lines.select(F.col("p_brand").alias("motion_class"), F.col("p_type").alias("gate"), F.col("l_discount").alias("metric"), "l_partkey"), ["motion_class", "gate"], "metric", "l_partkey")
    found = controls.separated_controls(profiles, promotions, runs)
    out = controls.derive_budgets(profiles, worst.select("motion_class", "gate", F.col("worst").alias("good"), F.col("binding").alias("sample")), found)
    return out.join(found.select("motion_class", "gate", F.col("reason").alias("control_reason")), ["motion_class", "gate"], "left")


def agg_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs whose gates are their lines; the first line's gate is the target."""
    names = F.array(*(F.lit(g) for g in gates.GATE_ORDER))
    n = F.col("l_linenumber")
    rows = _t(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.lit(gates.GATE_ORDER[0]).alias("target_gate"), F.element_at(names, n.cast("int")).alias("gate"), F.when(F.col("l_partkey") % 10 != 0, (F.col("l_partkey") * 37 % 1009).cast("double") / 1009).alias("metric"),
        F.when(n != 5, F.lit(0.45)).alias("budget"), F.when(F.col("l_suppkey") % 3 == 0, "undecidable").when(F.col("l_suppkey") % 3 == 1, "fail").otherwise("pass").alias("outcome"), F.lit("gate-control-measurement/0").alias("schema"), F.concat(F.lit("cfg"), F.col("l_orderkey") % 3).alias("config"),
        F.when(F.col("l_orderkey") % 4 == 0, F.struct(F.lit("older").alias("schema"), F.lit("cfg0").alias("config"))).alias("rescore_of"),
    )
    _, verdicts = controls.rescore(rows)
    return verdicts.select("run_id", "isolation", "blockers", "caveats", F.col("rescore_of.schema").alias("was_schema"), F.col("rescore_of.config").alias("was_config"))


# Mutations that must not pass.
MUST_FAIL = {"idle": "recolour hop mirror slide", "blob_idle": "recolour hop slide", "emissive": "recolour hop slide mirror", "walk": "recolour hop mirror slide", "swing": "recolour hop mirror slide hold", "airborne": "recolour"}


def agg_adversarial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strips and their five mutations, judged by the changed cells between frames 1 and 2."""
    c, s = T.cells(spark, sf_dir), T.strips(spark, sf_dir)
    every = grid.mutate(c, T.W, T.H).unionByName(c.withColumn("mutation", F.lit("baseline")))
    side = lambda f, n: every.filter(F.col("frame") == f).select("strip_id", "mutation", "x", "y", F.col("rgb").alias(n))
    both = side(1, "p").join(side(2, "q"), ["strip_id", "mutation", "x", "y"], "full_outer").groupBy("strip_id", "mutation").agg(F.count_if(~F.col("p").eqNullSafe(F.col("q"))).alias("changed"), F.count("*").alias("n"))
    outcome = tristate(F.col("changed") / F.col("n"), F.lit("SEPARATED"), F.lit(0.9), F.lit(0.97))
    told = F.when(F.col("strip_id") % 3 != 0, F.col("strip_id") % 2 == 0)
    results = both.join(s.select("strip_id", "motion_class"), "strip_id").select("strip_id", F.concat(F.lit("s"), F.col("strip_id") % 20).alias("sample"), "motion_class", "mutation", outcome.alias("outcome"), told.alias("displacement"))
    must = spark.createDataFrame([(k, m) for k, v in MUST_FAIL.items() for m in v.split()], "motion_class string, mutation string")
    baselines = spark.createDataFrame([("walk", "REVIEW")], "motion_class string, outcome string")
    gaps = spark.createDataFrame([("s4", "hold", "not told"), ("s5", "hop", "not told")], "sample string, mutation string, gap string")
    return controls.adversarial_summary(results, baselines, must, gaps)


PROBES = [(0, "none", 0, 0), (1, "hop", 1, 3), (2, "slide", 1, 3), (3, "hop", 2, 2), (4, "slide", 2, 4)]


def agg_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether displacement flags a frame that was moved, and what it flags in strips that were not."""
    probes = spark.createDataFrame(PROBES, "probe int, mutation string, frame int, magnitude int")
    return controls.coverage_grid(T.cells(spark, sf_dir), T.frames(spark, sf_dir), T.classes(spark), probes)


def agg_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as samples, their flags as gates; predictions say that every order passes."""
    results, expectations = contract_tables(spark, sf_dir)
    o = _t(spark, sf_dir, "orders")
    predictions = o.select(F.col("o_orderkey").alias("id"), F.lit("PASS").alias("expect"), F.array().cast("array<string>").alias("wanted"))
    return controls.corpus_summary(results, expectations, predictions, o.filter("o_orderpriority like '5%'").select(F.col("o_orderkey").alias("id")))


def agg_coherence_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return controls.coherence_strict(T.cells(spark, sf_dir), T.frames(spark, sf_dir))


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """48 frames as the sixteen masks of three variants; every other tileset has full edges, and some no cells in mask 0."""
    c = T.cells(spark, sf_dir).withColumn("vec", F.col("strip_id") * 4 + F.col("frame"))
    c = c.select(F.expr("vec div 48").alias("tileset"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.expr("vec div 16") % 3 + 1).cast("int")).alias("variant"), (F.col("vec") % 16).cast("int").alias("mask"), "x", "y", F.lit(1).alias("rgb"))
    tiles = c.select("tileset", "variant", "mask").distinct().filter("tileset % 2 = 0")
    place = F.explode(F.sequence(F.lit(0), F.lit(7)))
    full = tiles.select("*", place.alias("x")).select("*", place.alias("y")).filter("x in (0, 7) or y in (0, 7)").withColumn("rgb", F.lit(1))
    return c.unionByName(full).distinct().filter("tileset % 3 <> 0 or mask <> 0 or (x not in (0, 7) and y not in (0, 7))")


def join_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.edge_report(packs.tile_edges(_tiles(spark, sf_dir), 8), ["a", "b", "c"])


ASSETS = ("walk", "idle", "tile", "lamp")


def join_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four parts to a pack; reports and releases are bound by digests, of which some are wrong."""
    p, k = _t(spark, sf_dir, "part"), F.col("p_partkey")
    p = p.withColumns({"pack_id": F.expr("p_partkey div 4"), "ord": (k % 4).cast("int"), "asset_id": F.element_at(F.array(*(F.lit(a) for a in ASSETS)), (k % 4 + 1).cast("int")), "sha": F.sha2(k.cast("string"), 256)})
    durations = F.when(k % 29 == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(100), F.lit(80)))
    kind = F.when(F.col("ord") > 1, "static").when(k % 31 == 0, "static").otherwise("animation")
    assets = p.select("pack_id", "ord", "asset_id", kind.alias("kind"), (k % 37 != 1).alias("loop"), durations.alias("durations"), F.when(k % 41 == 0, 3).alias("contact_frame"), F.when(k % 43 == 0, F.concat(F.lit("../r/"), k)).otherwise(F.concat(F.lit("r/"), k)).alias("report_path"), F.when(k % 23 == 0, F.reverse("sha")).otherwise(F.col("sha")).alias("report_sha"))
    releases = p.select("pack_id", "asset_id", F.concat(F.lit("f/"), k).alias("path"), F.when(k % 19 == 0, F.reverse("sha")).otherwise(F.col("sha")).alias("sha"))
    reports = p.select(F.concat(F.lit("r/"), k).alias("path"), F.when((F.col("ord") > 1) | (k % 31 == 0), "static/1").otherwise("animation/1").alias("schema"), F.when(k % 47 == 0, "FAIL").otherwise("PASS").alias("outcome"))
    files = p.select(F.concat(F.lit("r/"), k).alias("path"), F.col("sha").alias("actual")).union(p.filter("p_partkey % 53 <> 0").select(F.concat(F.lit("f/"), k), "sha"))
    cells = p.select(F.concat(F.lit("f/"), k).alias("path"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"), "p_size").select("path", (F.col("p_size") + F.col("i")).cast("int").alias("rgb"))
    palette = spark.range(1, 50).select(F.col("id").cast("int").alias("rgb"))
    policy = spark.createDataFrame([("walk", True, [100, 80], None), ("idle", True, [100, 80], None)], "asset_id string, loop boolean, durations array<int>, contact_frame int")
    return packs.check_packs(assets, releases, reports, files, cells, palette, policy, {"animation": "animation/1", "static": "static/1"})


def join_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as attempts, their lines as measured gates, their files by digest."""
    o, i = _t(spark, sf_dir, "orders"), F.col("o_orderkey")
    names = F.array(*(F.lit(g) for g in gates.GATE_QUESTION))
    sha = F.sha2(i.cast("string"), 256)
    attempts = o.select(i.cast("string").alias("attempt_id"), F.when(i % 9 == 0, sha).alias("raw_sha256"))
    gate = F.element_at(names, (F.col("l_linenumber") % 5 + 1).cast("int"))
    runs = _t(spark, sf_dir, "lineitem").filter("l_linenumber < 6").groupBy(F.col("l_orderkey").cast("string").alias("attempt_id"), F.when(F.col("l_orderkey") % 2 == 0, "walk").otherwise("idle").alias("motion_class"), gate.alias("gate")).agg(F.max("l_discount").alias("metric"), F.max("l_tax").alias("budget"))
    runs = runs.withColumns({"target_gate": F.lit("silhouette_budget"), "caveats": F.when(F.col("metric") > 0.05, F.array(F.lit("c")))})
    provenance = o.filter("o_orderkey % 13 <> 0").select(i.cast("string").alias("attempt_id"), F.concat(F.lit("raw/"), i).alias("raw_path"), F.when(i % 17 == 0, F.reverse(sha)).otherwise(sha).alias("raw_sha256"))
    files = o.filter("o_orderkey % 19 <> 0").select(F.concat(F.lit("raw/"), i).alias("path"), sha.alias("sha256"))
    first = o.agg(F.min(F.when(i % (13 * 19 * 17) != 0, i)).cast("string").alias("c"))
    rows = [(m, g, s, b, h) for m in ("walk", "idle") for g, s, b, h in (("silhouette_budget", "SEPARATED", 0.25, 0.5), ("loop_closure_pass", "UNSEPARATED", None, None), ("palette_drift_pass", "SEPARATED", 0.125, 0.75), ("min_pair_cohort_pass", "UNSEPARATED", 0.5, None)) if (m, g) != ("idle", "loop_closure_pass")]
    profiles = spark.createDataFrame(rows, "motion_class string, gate string, status string, budget double, hard_fail double").crossJoin(F.broadcast(first)).withColumn("active_promotion", F.lit(None).cast("string"))
    profiles = profiles.withColumn("control_attempt", F.when((F.col("status") == "SEPARATED") & (F.concat("motion_class", "gate") != "idlepalette_drift_pass"), F.col("c"))).drop("c")
    goods = spark.createDataFrame([("walk", "silhouette_budget", "good/1", "00")], "motion_class string, gate string, path string, sha256 string")
    out = review.review_packets(attempts, runs, provenance, files, profiles, goods)
    return out.select("attempt_id", "gate", "budget", F.col("gate_control.path").alias("control"), "no_hard_fail_reason", "packet_sha256", "reason")


def fn_self_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "supplier").select("s_suppkey", evidence.self_digest(F.struct("s_name", "s_nationkey", "s_suppkey")).alias("digest"))


def agg_blind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First turns as first reviews, second turns as what a second reviewer is given."""
    c, conv = _t(spark, sf_dir, "conversations"), F.col("conv_id")
    firsts = c.filter("turn = 0").select(conv.alias("packet"), F.concat(F.lit("r"), conv).alias("review_id"), F.lit("alice").alias("reviewer_identity"), F.when(conv % 2 == 0, "the").otherwise("REJECT").alias("verdict"), F.substring("text", 1, 12).alias("rationale"))
    seconds = c.filter("turn = 1").select(conv.alias("packet"), F.when(conv % 17 == 0, F.concat(F.lit("r"), conv)).otherwise("r").alias("review_id"), F.when(conv % 19 == 0, "alice").otherwise("bob").alias("reviewer_identity"), F.when(conv % 5 == 0, F.concat(F.lit("see r"), conv)).otherwise(F.col("text")).alias("payload"))
    return review.blinding_leaks(seconds, firsts)


def agg_offline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last event of each user as the snapshots before and after."""
    e = _t(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    cents, i = F.floor(F.col("value") * 100 + 0.5).cast("long"), F.col("event_id")
    shots = e.select("user_id", "at", cents.alias("advance"), (i % 50).alias("ingots"), (i % 31).alias("ore"), (i % 7).alias("bagOre"), (i % 3).alias("heapOre"))
    names = ("advance", "ingots", "ore", "bagOre", "heapOre")
    end = lambda f: shots.groupBy("user_id").agg(f(F.struct(*names), "at").alias("s")).select("user_id", "s.*")
    return ledger.offline_summary(end(F.min_by), end(F.max_by), "user_id")


def set_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as promotions of six slices, some of none, when part 20 became active."""
    p, k = _t(spark, sf_dir, "part"), F.concat(F.lit("p"), F.col("p_partkey"))
    slices = p.filter("p_partkey % 7 <> 0").select(k.alias("id"), (F.col("p_partkey") % 6).alias("slice"))
    return ledger.reset_slices(p.select(k.alias("id"), F.col("p_type").alias("status")), slices, "p20", "ACTIVE")


CAN = "ceil(CAST({} AS DECIMAL(20,16)) * 10000)::DOUBLE / 10000"
_ENTRIES = "','".join(gates.GATE_QUESTION)
_QUESTIONS = " ".join(f"WHEN '{g}' THEN '{q}'" for g, (q, _) in gates.GATE_QUESTION.items())
_PANELS = " ".join(f"WHEN '{g}' THEN '{p}'" for g, (_, p) in gates.GATE_QUESTION.items())
_PATHS = {x: f"CASE WHEN doc_id % {13 + len(x)} = 0 THEN 'a/../b' ELSE '{x}/' || doc_id END" for x in LABELS}
_BINDINGS = [r for k, x in enumerate(LABELS) for r in (
    *([(f"doc_id % {len(x) - 3} = 0", f"missing_binding_{x}")] if k < 3 else []), (f"doc_id % {len(x) - 3} <> 0 AND doc_id % {13 + len(x)} = 0", f"path_escape_{x}"),
    (f"doc_id % {len(x) - 3} <> 0 AND doc_id % 17 = 3", f"missing_{x}"), (f"doc_id % {len(x) - 3} <> 0 AND doc_id % {11 + 2 * k} = 0 AND sha256(text) <> reverse(sha256(text))", f"mismatch_{x}"),
)]
_PROBED = T.CELLS.replace("cells AS (", "cells0 AS (").replace("FROM e WHERE v > 0),", f"""FROM e WHERE v > 0), probes AS (SELECT * FROM (VALUES {','.join(map(str, PROBES))}) v(probe, mutation, pf, magnitude)),
cells AS (SELECT * FROM (SELECT strip_id * 8 + probe AS strip_id, frame, CASE WHEN mutation = 'slide' AND frame = pf THEN x + magnitude ELSE x END AS x, CASE WHEN mutation = 'hop' AND frame = pf THEN y - magnitude ELSE y END AS y, rgb FROM cells0, probes) WHERE x < 8 AND y >= 0),""").replace("frames AS (", "frames0 AS (").replace("strips AS (", "frames AS (SELECT strip_id * 8 + probe AS strip_id, frame, w, h, motion_class FROM frames0, probes),\nstrips AS (", 1)
_ADJ = "adj AS (SELECT a.*, i AS a, (i + 1) % n AS b FROM anchors a, range(16) t(i) WHERE i < n AND (i < n - 1 OR (loops AND n > 1)))"
_MUTATED = """m2 AS (SELECT strip_id, 'baseline' AS mutation, x, y, rgb FROM cells WHERE frame = 2 UNION ALL SELECT strip_id, 'recolour', x, y, least(255, rgb // 65536 + 110) * 65536 + (rgb // 256 % 256) // 3 * 256 + (rgb % 256) // 3 FROM cells WHERE frame = 2 UNION ALL SELECT strip_id, 'hop', x, y - 3, rgb FROM cells WHERE frame = 2 AND y >= 3
UNION ALL SELECT strip_id, 'mirror', 7 - x, y, rgb FROM cells WHERE frame = 2 UNION ALL SELECT strip_id, 'slide', x + 3, y, rgb FROM cells WHERE frame = 2 AND x < 5 UNION ALL SELECT strip_id, 'hold', x, y, rgb FROM cells WHERE frame = 1),
m1 AS (SELECT strip_id, mutation, x, y, rgb FROM cells, (VALUES ('baseline'), ('recolour'), ('hop'), ('mirror'), ('slide'), ('hold')) v(mutation) WHERE frame = 1)"""
_JSON = """'{"attempt_id":"' || attempt_id || '","budget":' || coalesce(CAST(budget AS VARCHAR), 'null') || ',"budget_binding_good":' || CASE WHEN motion_class = 'walk' AND gate = 'silhouette_budget' THEN '{"path":"good/1","raw_sha256":"00","role":"budget_binding_good"}' ELSE 'null' END
 || ',"candidate":{"path":"raw/' || attempt_id || '","raw_sha256":"' || sha || '","role":"candidate"},"caveats":' || CASE WHEN metric > 0.05 THEN '["c"]' ELSE '[]' END || ',"fixed_question":"' || CASE gate %s END || '","gate":"' || gate || '","gate_control":' || CASE WHEN control IS NULL THEN 'null' ELSE '{"path":"raw/' || control || '","raw_sha256":"' || sha256(control) || '","role":"gate_control"}' END
 || ',"hard_fail":' || coalesce(CAST(hard_fail AS VARCHAR), 'null') || ',"metric":' || CAST(metric AS VARCHAR) || ',"motion_class":"' || motion_class || '","no_hard_fail_reason":' || coalesce('"' || no_reason || '"', 'null') || ',"packet_kind":"CANDIDATE_REVIEW","panel_kind":"' || CASE gate %s END || '","promotion_id":null,"promotion_status":null,"proposed_hard_fail_reference":null}'""" % (_QUESTIONS, _PANELS)
SQL = {
    "join_allowlist": "SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM documents a WHERE a.doc_id % 10 = 0 AND a.source = d.source AND sha256(a.text) = sha256(d.text))",
    "join_attestation": """SELECT conv_id AS bundle_id, CASE WHEN conv_id % 13 = 0 THEN 'cell-author' WHEN conv_id % 11 = 0 THEN 'legacy' WHEN NOT bool_or(turn = conv_id % 4) THEN 'attempt_not_registered' WHEN conv_id % 5 <> 0 AND conv_id % 7 <> 0 THEN 'attested' ELSE 'attempt_ledger_not_attested' END AS state FROM conversations GROUP BY 1""",
    "join_evidence_bindings": "SELECT doc_id AS bundle_id, " + _rules(*_BINDINGS) + " AS reason FROM documents",
    "join_controls": f"""WITH p AS (SELECT p_brand AS motion_class, p_type AS gate, min(p_partkey) AS k FROM part GROUP BY ALL), w AS (SELECT p_brand AS motion_class, p_type AS gate, max(l_discount) AS good, min(l_partkey) FILTER (l_discount = top) AS sample FROM (SELECT *, max(l_discount) OVER (PARTITION BY p_brand, p_type) AS top FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY ALL),
s AS (SELECT *, CASE WHEN k % 4 = 0 THEN 'UNSEPARATED' WHEN k % 9 = 0 THEN 'INAPPLICABLE' ELSE 'SEPARATED' END AS status, CASE WHEN k % 19 <> 0 THEN 0.25::DOUBLE END AS old, CASE WHEN k % 13 <> 0 THEN (k * 37 % 64)::DOUBLE / 64 END AS control FROM p LEFT JOIN w USING (motion_class, gate)),
r AS (SELECT *, CASE WHEN status = 'SEPARATED' THEN {_rules(("k % 5 = 0", "no_promotion"), ("k % 7 = 0", "unknown_promotion"), ("k % 11 = 0", "not_active"), ("control IS NULL", "invalid_measurement"))} END AS control_reason, {CAN.format("good")} AS g, {CAN.format("control")} AS c FROM s),
b AS (SELECT *, {CAN.format("g + (c - g) * 0.5")} AS x FROM r), d AS (SELECT *, CASE WHEN status = 'SEPARATED' THEN CASE WHEN c > g AND x >= g AND x < c THEN x END WHEN status = 'UNSEPARATED' THEN old END AS v FROM b),
e AS (SELECT *, {_rules(("status = 'INAPPLICABLE'", "inapplicable"), ("good IS NULL", "no_good_sample"), ("old IS NULL", "no_budget_in_use"), ("status = 'SEPARATED' AND (control_reason IS NOT NULL OR control IS NULL)", "blocked_control"), ("status = 'SEPARATED' AND v IS NULL", "no_gap"))} AS reason FROM d)
SELECT motion_class, gate, status, sample, CASE WHEN reason IS NULL THEN v END AS budget, CASE WHEN reason IS NULL THEN floor((v - old) * 10000 + 0.5) / 10000 END AS delta, CASE WHEN reason IS NULL THEN floor((v - g) * 10000 + 0.5) / 10000 END AS headroom, CASE WHEN reason IS NULL AND status = 'SEPARATED' THEN floor((c - v) * 10000 + 0.5) / 10000 END AS review_width, reason, control_reason FROM e""",
    "agg_rescore": f"""WITH g AS (SELECT l_orderkey AS run_id, ['{"','".join(gates.GATE_ORDER)}'][l_linenumber] AS gate, l_linenumber AS n, CASE WHEN l_partkey % 10 <> 0 THEN {CAN.format("(l_partkey * 37 % 1009)::DOUBLE / 1009")} END AS m, CASE l_suppkey % 3 WHEN 0 THEN 'undecidable' WHEN 1 THEN 'fail' ELSE 'pass' END AS was FROM lineitem),
o AS (SELECT *, CASE WHEN m IS NULL OR n = 5 THEN was WHEN m <= 0.45 THEN 'pass' ELSE 'fail' END AS outcome FROM g),
v AS (SELECT run_id, max(outcome) FILTER (n = 1) AS target, count(*) FILTER (n <> 1 AND outcome = 'fail') AS others, string_agg(gate, ',' ORDER BY gate) FILTER (n <> 1 AND outcome = 'fail') AS blockers, count(*) FILTER (n <> 1 AND outcome = 'undecidable') AS caveats FROM o GROUP BY 1)
SELECT run_id, CASE WHEN target = 'undecidable' THEN 'INDETERMINATE' WHEN target = 'fail' AND others = 0 THEN 'ISOLATED' ELSE 'NOT_ISOLATED' END AS isolation, coalesce(blockers, '') AS blockers, caveats, CASE WHEN run_id % 4 = 0 THEN 'older' ELSE 'gate-control-measurement/0' END AS was_schema, CASE WHEN run_id % 4 = 0 THEN 'cfg0' ELSE 'cfg' || run_id % 3 END AS was_config FROM v""",
    "agg_adversarial": f"WITH {T.CELLS}, {_MUTATED}, d AS (SELECT strip_id, mutation, count(*) FILTER (m1.rgb IS DISTINCT FROM m2.rgb) AS changed, count(*) AS n FROM m1 FULL JOIN m2 USING (strip_id, mutation, x, y) GROUP BY ALL), o AS (SELECT strip_id, 's' || strip_id % 20 AS sample, motion_class, mutation, {CAN.format('changed / d.n')} AS m FROM d JOIN strips USING (strip_id)), "
    + "p AS (SELECT *, CASE WHEN m <= 0.9 THEN 'PASS' WHEN m >= 0.97 THEN 'FAIL' ELSE 'REVIEW' END AS outcome, CASE WHEN (sample = 's4' AND mutation = 'hold') OR (sample = 's5' AND mutation = 'hop') THEN 'not told' END AS gap FROM o), w AS (SELECT *, CASE WHEN mutation = 'baseline' THEN CASE WHEN motion_class = 'walk' THEN 'REVIEW' ELSE 'PASS' END "
    + " ".join(f"WHEN motion_class = '{k}' AND mutation IN (" + ", ".join(f"'{m}'" for m in v.split()) + ") THEN 'not PASS'" for k, v in MUST_FAIL.items())
    + " WHEN gap IS NOT NULL THEN 'not PASS (ungated)' WHEN motion_class = 'airborne' AND mutation IN ('hop', 'slide') AND strip_id % 3 <> 0 AND strip_id % 2 <> 0 THEN 'not PASS' WHEN motion_class = 'airborne' AND mutation IN ('hop', 'slide') AND strip_id % 3 = 0 THEN 'not PASS (inapplicable)' ELSE 'PASS' END AS want FROM p)"
    + " SELECT strip_id, sample, motion_class, mutation, outcome, want, CASE WHEN want LIKE '%(%' THEN 'GAP' WHEN want = 'not PASS' AND outcome <> 'PASS' THEN 'ok' WHEN want = outcome THEN 'ok' ELSE 'MISMATCH' END AS verdict, gap FROM w",
    "agg_coverage": f"WITH {_PROBED}, {_ADJ}, {_scores('s2', 'adj', 4, 4)}, best AS (SELECT * FROM s2_best WHERE r = 1), " + """flags AS (SELECT x.strip_id, x.b AS frame FROM best x JOIN best y ON x.strip_id = y.strip_id AND x.b = y.a JOIN anchors s ON s.strip_id = x.strip_id
 WHERE n >= 3 AND (loops OR (x.b > 0 AND x.b < n - 1)) AND greatest(abs(x.dx), abs(x.dy)) >= 2 AND greatest(abs(x.dx + y.dx), abs(x.dy + y.dy)) <= 1)
SELECT s.strip_id // 8 AS strip_id, motion_class, probe, mutation, pf AS frame, magnitude, coalesce(bool_or(mutation <> 'none' AND f.frame = pf), false) AS detected, count(f.frame) FILTER (mutation = 'none' OR f.frame <> pf) AS others FROM strips s JOIN probes p ON p.probe = s.strip_id % 8 LEFT JOIN flags f ON f.strip_id = s.strip_id GROUP BY ALL""",
    "agg_coherence_legacy": f"WITH {T.CELLS}, " + """p AS (SELECT strip_id, i AS a, (i + 1) % n AS b FROM strips, range(16) t(i) WHERE i < n AND n > 1),
l AS (SELECT p.*, x, y, c.rgb AS p FROM p JOIN cells c ON c.strip_id = p.strip_id AND c.frame = a), r AS (SELECT p.*, x, y, c.rgb AS q FROM p JOIN cells c ON c.strip_id = p.strip_id AND c.frame = b),
f AS (SELECT strip_id, a, b, floor(count(*) FILTER (p IS DISTINCT FROM q) / count(*) * 10000 + 0.5) / 10000 AS frac FROM l FULL JOIN r USING (strip_id, a, b, x, y) GROUP BY ALL),
low AS (SELECT b.strip_id, b.frame, baseline, coalesce(string_agg(x || ':' || rgb, ',' ORDER BY x), '') AS floor FROM base b LEFT JOIN cells c ON c.strip_id = b.strip_id AND c.frame = b.frame AND c.y = baseline GROUP BY ALL),
pal AS (SELECT f.strip_id, f.frame, coalesce(string_agg(DISTINCT CAST(rgb AS VARCHAR), ',' ORDER BY CAST(rgb AS VARCHAR)), '') AS pal FROM frames f LEFT JOIN cells c USING (strip_id, frame) GROUP BY ALL),
g AS (SELECT s.strip_id, true AS dimension_parity, (SELECT count(DISTINCT coalesce(baseline, -1)) = 1 FROM low WHERE low.strip_id = s.strip_id) AS baseline_row_stable,
 NOT EXISTS (SELECT 1 FROM p JOIN low x ON x.strip_id = p.strip_id AND x.frame = a JOIN low y ON y.strip_id = p.strip_id AND y.frame = b WHERE p.strip_id = s.strip_id AND x.floor <> y.floor) AS baseline_cells_locked,
 coalesce((SELECT max(frac) FROM f WHERE f.strip_id = s.strip_id AND b > 0), 0) AS worst, coalesce((SELECT max(frac) FROM f WHERE f.strip_id = s.strip_id AND b = 0), 0) AS loop, (SELECT count(DISTINCT pal) = 1 FROM pal WHERE pal.strip_id = s.strip_id) AS palette_set_equal FROM strips s)
SELECT strip_id, dimension_parity, baseline_row_stable, baseline_cells_locked, worst <= 0.28 AS adjacent_diff_budget, loop <= 0.28 AS loop_closure_pass, palette_set_equal, worst, loop, dimension_parity AND baseline_row_stable AND baseline_cells_locked AND worst <= 0.28 AND loop <= 0.28 AND palette_set_equal AS pass FROM g""",
    "join_edges": f"WITH {T.CELLS}, " + """c0 AS (SELECT (strip_id * 4 + frame) // 48 AS tileset, ['a','b','c'][(strip_id * 4 + frame) // 16 % 3 + 1] AS variant, CAST((strip_id * 4 + frame) % 16 AS INT) AS mask, x, y FROM cells),
c1 AS (SELECT * FROM c0 UNION SELECT tileset, variant, mask, i, j FROM (SELECT DISTINCT tileset, variant, mask FROM c0 WHERE tileset % 2 = 0), range(8) t(i), range(8) u(j) WHERE i IN (0, 7) OR j IN (0, 7)),
c AS (SELECT * FROM c1 WHERE tileset % 3 <> 0 OR mask <> 0 OR (x NOT IN (0, 7) AND y NOT IN (0, 7))), t AS (SELECT DISTINCT tileset, variant, mask FROM c),
ed AS (SELECT t.*, (SELECT coalesce(string_agg(CAST(x AS VARCHAR), '' ORDER BY x), '') FROM c WHERE c.tileset = t.tileset AND c.variant = t.variant AND c.mask = t.mask AND y = 0) AS north, (SELECT coalesce(string_agg(CAST(y AS VARCHAR), '' ORDER BY y), '') FROM c WHERE c.tileset = t.tileset AND c.variant = t.variant AND c.mask = t.mask AND x = 7) AS east,
 (SELECT coalesce(string_agg(CAST(x AS VARCHAR), '' ORDER BY x), '') FROM c WHERE c.tileset = t.tileset AND c.variant = t.variant AND c.mask = t.mask AND y = 7) AS south, (SELECT coalesce(string_agg(CAST(y AS VARCHAR), '' ORDER BY y), '') FROM c WHERE c.tileset = t.tileset AND c.variant = t.variant AND c.mask = t.mask AND x = 0) AS west FROM t),
pr AS (SELECT a.tileset, a.east <> b.west AS bad FROM ed a JOIN ed b ON a.tileset = b.tileset AND a.variant = b.variant WHERE (a.mask & 2) > 0 AND (b.mask & 8) > 0 UNION ALL SELECT a.tileset, a.south <> b.north FROM ed a JOIN ed b ON a.tileset = b.tileset AND a.variant = b.variant WHERE (a.mask & 4) > 0 AND (b.mask & 1) > 0),
gm AS (SELECT a.tileset, a.mask, bool_or(a.north <> b.north) AS n, bool_or(a.east <> b.east) AS e, bool_or(a.south <> b.south) AS s, bool_or(a.west <> b.west) AS w FROM ed a JOIN ed b ON a.tileset = b.tileset AND a.mask = b.mask AND a.variant IN ('b', 'c') AND b.variant = 'a' GROUP BY ALL),
ex AS (SELECT a.tileset, a.north <> b.north AND a.east <> b.east AND a.south <> b.south AND a.west <> b.west AS exposed FROM ed a JOIN ed b ON a.tileset = b.tileset AND a.variant = 'a' AND b.variant = 'a' AND a.mask = 0 AND b.mask = 15),
s AS (SELECT d.tileset, (SELECT count(*) FROM pr WHERE pr.tileset = d.tileset) AS pairs, (SELECT count(*) FILTER (bad) FROM pr WHERE pr.tileset = d.tileset) AS pair_failures, coalesce((SELECT sum(n::INT + e::INT + s::INT + w::INT) FROM gm WHERE gm.tileset = d.tileset), 0)::BIGINT AS geometry_failures, coalesce((SELECT exposed FROM ex WHERE ex.tileset = d.tileset), false) AS exposed FROM (SELECT DISTINCT tileset FROM ed) d)
SELECT *, CASE WHEN pair_failures = 0 AND geometry_failures = 0 AND exposed THEN 'PASS' ELSE 'FAIL' END AS outcome FROM s""",
    "join_pack": """WITH p AS (SELECT p_partkey AS k, p_partkey // 4 AS pack_id, p_partkey % 4 AS ord, p_size FROM part), f AS (SELECT *, CASE WHEN ord < 2 THEN """ + _rules(("k % 31 = 0", "metadata_kind"), ("k % 37 = 1", "loop"), ("k % 29 = 0", "durations"), ("k % 41 = 0", "contact_frame")) + """ END AS r0,
""" + _rules(("k % 43 = 0", "path_escape_report"), ("k % 23 = 0 AND sha256(CAST(k AS VARCHAR)) <> reverse(sha256(CAST(k AS VARCHAR)))", "mismatch_report"), ("k % 47 = 0", "report_not_pass")) + " AS r1, " + _rules(("k % 53 = 0", "missing_release"), ("k % 19 = 0", "mismatch_release"), ("p_size + 2 > 49", "palette_violation")) + """ AS r2 FROM p),
u AS (SELECT pack_id, 0 AS step, ord, r0 AS reason FROM f UNION ALL SELECT pack_id, 1, ord, r1 FROM f UNION ALL SELECT pack_id, 2, ord, r2 FROM f), z AS (SELECT *, row_number() OVER (PARTITION BY pack_id ORDER BY step, ord, reason) AS rn FROM u WHERE reason IS NOT NULL)
SELECT d.pack_id, CASE WHEN reason IS NULL THEN 'PASS' ELSE 'FAIL' END AS outcome, reason FROM (SELECT DISTINCT pack_id FROM p) d LEFT JOIN z ON z.pack_id = d.pack_id AND rn = 1""",
    "join_packet": f"""WITH m AS (SELECT l_orderkey AS k, CASE WHEN l_orderkey % 2 = 0 THEN 'walk' ELSE 'idle' END AS motion_class, ['{_ENTRIES}'][l_linenumber % 5 + 1] AS gate, max(l_discount) AS metric, max(l_tax) AS tax FROM lineitem WHERE l_linenumber < 6 GROUP BY ALL), c AS (SELECT CAST(min(o_orderkey) FILTER (o_orderkey % 4199 <> 0) AS VARCHAR) AS c FROM orders),
pr AS (SELECT *, CASE WHEN status = 'SEPARATED' AND NOT (motion_class = 'idle' AND gate = 'palette_drift_pass') THEN c END AS control_id FROM (VALUES ('silhouette_budget', 'SEPARATED', 0.25::DOUBLE, 0.5::DOUBLE), ('loop_closure_pass', 'UNSEPARATED', NULL, NULL), ('palette_drift_pass', 'SEPARATED', 0.125, 0.75), ('min_pair_cohort_pass', 'UNSEPARATED', 0.5, NULL)) v(gate, status, pb, hard_fail), (VALUES ('walk'), ('idle')) w(motion_class), c WHERE NOT (motion_class = 'idle' AND gate = 'loop_closure_pass')),
j AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS attempt_id, m.motion_class, m.gate, metric, coalesce(pb, tax) AS budget, status, hard_fail, CASE WHEN CAST(control_id AS BIGINT) % 13 <> 0 AND CAST(control_id AS BIGINT) % 19 <> 0 THEN control_id END AS ctl, sha256(CAST(o_orderkey AS VARCHAR)) AS sha FROM orders LEFT JOIN m ON m.k = o_orderkey LEFT JOIN pr ON pr.motion_class = m.motion_class AND pr.gate = m.gate),
r AS (SELECT *, CASE WHEN status = 'SEPARATED' THEN ctl END AS control, CASE WHEN coalesce(status, '') <> 'SEPARATED' THEN concat_ws(' ', '{review.NO_HARD_FAIL}', concat_ws('/', motion_class, gate)) END AS no_reason, {_rules(("gate IS NULL", "missing_measurement"), ("k % 13 = 0", "missing_provenance"), ("k % 19 = 0", "missing_file"), ("k % 17 = 0", "hash_mismatch"), ("status IS NULL", "missing_profile"), ("status = 'SEPARATED' AND ctl IS NULL", "missing_control"))} AS reason FROM j)
SELECT attempt_id, gate, budget, CASE WHEN status = 'SEPARATED' AND ctl IS NOT NULL THEN 'raw/' || ctl END AS control, no_reason AS no_hard_fail_reason, CASE WHEN reason IS NULL THEN sha256({_JSON}) END AS packet_sha256, reason FROM r""",
    "fn_self_digest": """SELECT s_suppkey, sha256('{"s_name":"' || s_name || '","s_nationkey":' || s_nationkey || ',"s_suppkey":' || s_suppkey || '}') AS digest FROM supplier""",
    "agg_blind": """SELECT b.conv_id AS packet, CASE WHEN b.conv_id % 17 = 0 THEN 'r' || b.conv_id ELSE 'r' END AS review_id, CASE WHEN b.conv_id % 17 = 0 THEN 'same_review' WHEN b.conv_id % 19 = 0 THEN 'same_reviewer' WHEN contains(pay, CASE WHEN b.conv_id % 2 = 0 THEN 'the' ELSE 'REJECT' END) THEN 'verdict' WHEN substr(a.text, 1, 12) <> '' AND contains(pay, substr(a.text, 1, 12)) THEN 'rationale' WHEN contains(pay, 'r' || b.conv_id) THEN 'review_id' END AS leak
FROM conversations a JOIN (SELECT *, CASE WHEN conv_id % 5 = 0 THEN 'see r' || conv_id ELSE text END AS pay FROM conversations WHERE turn = 1) b ON a.conv_id = b.conv_id AND a.turn = 0""",
    "agg_offline": """WITH s AS (SELECT *, CAST(floor(value * 100 + 0.5) AS BIGINT) AS adv, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS j FROM events)
SELECT a.user_id, z.adv - a.adv AS advance_gained, z.event_id % 50 - a.event_id % 50 AS ore_smelted, z.event_id % 31 - a.event_id % 31 + z.event_id % 7 - a.event_id % 7 + z.event_id % 3 - a.event_id % 3 + z.event_id % 50 - a.event_id % 50 AS ore_produced, z.event_id % 31 AS ore_backlog FROM s a JOIN s z ON a.user_id = z.user_id AND a.i = 1 AND z.j = 1""",
    "set_slices": "SELECT 'p' || p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN p_type WHEN p_partkey % 6 > 2 THEN 'PENDING_VERIFICATION' WHEN p_partkey % 6 = 2 THEN 'ACTIVE' ELSE p_type END AS status FROM part",
}
SQL["agg_corpus"] = """WITH t AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, n, coalesce(t, []) AS t FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, coalesce(list(DISTINCT l_returnflag) FILTER (l_tax > 0.07), []) AS t FROM lineitem WHERE l_orderkey % 10 <> 0 GROUP BY 1) ON l_orderkey = o_orderkey)
SELECT count(n) AS scored, count(*) - count(n) AS pending, count(*) FILTER (n IS NOT NULL AND NOT CASE o_orderstatus WHEN 'O' THEN len(t) = 0 WHEN 'F' THEN list_contains(t, 'A') OR list_contains(t, 'N') ELSE list_contains(t, 'R') AND (list_contains(t, 'A') OR list_contains(t, 'N')) END) AS regressions,
count(*) FILTER (n IS NOT NULL AND len(t) > 0) AS ledger_mismatches, count(DISTINCT o_orderkey) FILTER (o_orderpriority LIKE '5%') AS inapplicable FROM t"""
QUERIES = {n: globals()[n] for n in SQL}
