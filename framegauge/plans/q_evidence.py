"""Queries of evidence, review and source checks, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import controls, deltas, graph, replay
from ..sources import testdata as T
from ..sources.shared import cut


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return T.table(spark, sf_dir, name)


def src_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.pairing(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"), ["doc_id"])


def join_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    path = F.concat(F.when(F.col("doc_id") % 17 == 0, "../").otherwise("raw/"), F.col("doc_id"))
    claims = d.select(F.col("doc_id").alias("id"), path.alias("path"), F.when(F.col("doc_id") % 7 == 0, F.reverse("sha")).otherwise(F.col("sha")).alias("digest"))
    files = d.filter("doc_id % 11 <> 0").select(F.concat(F.lit("raw/"), F.col("doc_id")).alias("path"), F.col("sha").alias("actual"))
    return E.binding_check(claims, files, "raw")


def _graph(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Customers as specifications with a promotion of their first order, orders as attempts; links and digests are
    broken by the numbers of keys."""
    c, o = _t(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "k"), _t(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "a")
    if_, sha = lambda n, r, yes, no: f"if(k % {n} = {r}, {yes}, {no})", "sha2(cast(a as string), 256)"
    specifications = c.selectExpr("concat('s', k) as id", "concat('c', k % 6) as motion_class", "concat('g', k % 5) as target_gate", f"{if_(9, 0, 'null', if_(41, 3, 'concat(chr(112), k + 1)', 'concat(chr(112), k)'))} as active_promotion")
    first = o.groupBy(F.col("o_custkey").alias("k")).agg(F.min("a").alias("a"))
    promotions = first.filter("k % 29 <> 2").selectExpr("concat('p', k) as id", f"concat('s', {if_(31, 4, '-k', 'k')}) as specification_id", f"concat('a', {if_(37, 5, '-a', 'a')}) as attempt_id", f"concat('m', {if_(43, 6, '-a', 'a')}) as measurement_path", f"{if_(8, 1, repr('PENDING'), repr('ACTIVE'))} as status")
    k = o.withColumnRenamed("o_custkey", "k")
    attempts = k.selectExpr("concat('a', a) as attempt_id", "concat('s', if(a % 47 = 7, k + 1, k)) as specification_id", "if(a % 53 = 8, 'discarded', 'retained') as artifact_state", "if(a % 7 = 1, '', concat('m', a)) as measurement_path", "if(a % 59 = 9, null, concat('v', a)) as provenance_path", f"case when a % 61 = 10 then null when a % 67 = 11 then 'x' else {sha} end as raw_sha256")
    attempts = attempts.unionByName(attempts.filter("attempt_id like '%777'"))
    measurements = k.filter("a % 71 <> 12").selectExpr("concat('m', a) as path", "concat('c', if(a % 73 = 13, 9, k % 6)) as motion_class", "concat('g', if(a % 79 = 14, 9, k % 5)) as target_gate", f"case when a % 83 = 15 then 'y' else {sha} end as raw_sha256")
    provenances = k.filter("a % 89 <> 16").selectExpr("concat('v', a) as path", "concat('a', if(a % 97 = 17, a + 1, a)) as attempt_id", "concat('s', case when a % 101 = 18 then -k when a % 47 = 7 then k + 1 else k end) as specification_id", "concat('r', a) as raw_path", f"case when a % 103 = 19 then 'z' when a % 107 = 20 then null else {sha} end as raw_sha256")
    files = k.filter("a % 13 <> 11").selectExpr("concat('r', a) as path", f"{sha} as actual")
    return [specifications, promotions, attempts, measurements, provenances, files]


def join_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first broken rule of every specification, promotion, attempt and profile."""
    tables = _graph(spark, sf_dir)
    profiles = tables[0].selectExpr("motion_class", "target_gate as gate", "'SEPARATED' as status", "if(id like '%3', 'p-1', active_promotion) as active_promotion")
    return graph.check_graph(*tables).unionByName(graph.check_profiles(profiles, tables[0], tables[1]))


def join_registered_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles that claim orders, against a store of orders whose digests are those of their customers."""
    o = _t(spark, sf_dir, "orders").withColumns({"sha": F.sha2(F.col("o_custkey").cast("string"), 256), "a": F.concat(F.lit("a"), "o_orderkey")})
    mode, kind = "if(o_orderkey % 9 = 4, 'edit', 'new')", "o_orderpriority"
    store = o.filter("o_orderkey % 17 <> 3").selectExpr("a as attempt_id", "o_orderkey as place", "sha as raw_sha256", "if(o_orderstatus = 'F', 'rejected', 'open') as outcome",
                                                       f"if(o_orderkey % 23 <> 7, struct({mode} as generation_mode, {kind} as motion_class, cast(o_orderkey % 3 as string) as prompt_sha256), null) as provenance")
    claims = o.selectExpr("a as attempt_id", "if(o_orderkey % 19 = 5, reverse(sha), sha) as provider_sha256", f"if(o_orderkey % 7 = 2, 'new', {mode}) as generation_mode", f"if(o_orderkey % 29 = 8, null, {kind}) as motion_class", "cast(o_orderkey % 3 + if(o_orderkey % 31 = 9, 1, 0) as string) as prompt_sha256")
    return graph.check_registration(claims, store).select("attempt_id", "reason")


def join_bundle_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even strips as provider bundles (a sheet of four frames, cut to six columns and five rows), odd ones as cell-authored
    ones (frames 0 and 2 as bases of 1 and 3); some drafts and ledgers were tampered with."""
    c = T.cells(spark, sf_dir).withColumnRenamed("strip_id", "bundle_id")
    bundles = T.strips(spark, sf_dir).select(F.col("strip_id").alias("bundle_id"), "motion_class", (F.col("strip_id") % 2 == 1).alias("cell_authored"))
    even, odd = c.filter("bundle_id % 2 = 0"), c.filter("bundle_id % 2 = 1")
    sheets = even.select("bundle_id", (F.col("frame") * 9 + F.col("x") + 1).alias("x"), "y", "rgb")
    origins = bundles.join(F.broadcast(T.classes(spark).select("motion_class", "origin_x", "origin_y")), "motion_class").select("bundle_id", "origin_x", "origin_y")
    derived = replay.provider_drafts(sheets, origins, 8, 1, 1, 6, 5, 8)
    # what was stored, by a formula of its own
    low = even.groupBy("bundle_id", "frame").agg(F.max("y").alias("low"))
    stored = even.join(low, ["bundle_id", "frame"]).join(origins, "bundle_id").selectExpr("bundle_id", "frame", "x + origin_x as x", "y - least(greatest(low - 4, 0), 3) as y", "if(bundle_id % 10 = 2 and frame = 2, rgb + 1, rgb) as rgb", "x as inner").filter("inner < 6 and y between 0 and 4 and not (bundle_id % 10 = 4 and frame = 3)").drop("inner")
    half = F.expr("cast(frame div 2 as int)")
    own = odd.withColumnRenamed("bundle_id", "ledger_id")
    base_cells, targets = (own.filter(F.col("frame") % 2 == k).withColumn(n, half).select("ledger_id", n, "x", "y", "rgb") for k, n in ((0, "base"), (1, "frame")))
    sizes = T.frames(spark, sf_dir).filter("strip_id % 2 = 1").withColumnRenamed("strip_id", "ledger_id")
    bases, dims = (sizes.filter(F.col("frame") % 2 == k).withColumn(n, half).select("ledger_id", n, "w", "h") for k, n in ((0, "base"), (1, "frame")))
    ledgers = sizes.select("ledger_id").distinct().withColumn("mapping", F.expr("array(0, 1)"))
    changed, _ = deltas.build_ledgers(ledgers, bases, base_cells, dims, targets)
    changed = changed.withColumn("after", F.when((F.col("ledger_id") % 10 == 5) & (F.col("place") == 2), F.col("before")).otherwise(F.col("after")))
    changed = cut(changed, "deltas")
    digests = deltas.frame_digests(bases, base_cells, "base").groupBy("ledger_id").agg(F.array_sort(F.collect_list(F.struct("base", "sha256")))["sha256"].alias("digests"))
    ledgers = cut(ledgers.join(digests, "ledger_id").withColumns({"schema": F.lit(deltas.SCHEMA), "target_count": F.lit(2)}), "ledgers")
    drafts = targets.withColumnRenamed("ledger_id", "bundle_id").withColumn("rgb", F.expr("if(bundle_id % 10 = 3 and frame = 1, rgb + 1, rgb)"))
    return replay.check_drafts(bundles.select("bundle_id", "cell_authored"), stored.unionByName(drafts), derived, ledgers, bases, base_cells, changed)


def join_projection_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    other = p.filter("p_partkey % 31 <> 4").withColumn("p_size", F.when(F.col("p_partkey") % 9 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return E.projection_mismatches(p, other, ["p_partkey"], ["p_brand", "p_size"])


def join_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    second = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 19 == 0, "P").otherwise(F.col("o_orderstatus")))
    return E.divergence(o, second, "o_orderkey", "o_orderstatus")


def contract_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Line flags of orders as tripped gates, of which every tenth order has none yet; and what is expected."""
    li = _t(spark, sf_dir, "lineitem").filter("l_orderkey % 10 <> 0").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.when(F.col("l_tax") > 0.07, F.col("l_returnflag"))).alias("tripped"))
    wanted = F.when(F.col("o_orderstatus") == "O", F.array().cast("array<string>")).when(F.col("o_orderstatus") == "F", F.array(F.lit("A|N"))).otherwise(F.array(F.lit("R"), F.lit("A|N")))
    ex = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "PASS").otherwise("REVIEW").alias("expect"), wanted.alias("wanted"))
    return li, ex


def join_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.contract(*contract_tables(spark, sf_dir))


POLICY = {"rounding": "ceiling", "places": 4, "epsilon": 0, "comparison": "metric <= budget"}


def fn_config_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types as configurations: brands as classes, parts as gates and as promotions with their measurements."""
    p, k = _t(spark, sf_dir, "part").withColumnRenamed("p_type", "config_id"), F.col("p_partkey")
    profiles = p.select("config_id", F.col("p_brand").alias("motion_class"), F.concat(F.lit("gé"), k).alias("gate"), F.when(k % 3 == 0, "UNSEPARATED").otherwise("SEPARATED").alias("status"),
                        F.when(k % 5 != 0, k * 37 % 64 / 64).alias("budget"), F.when(k % 3 != 0, k * 11 % 32 / 16 + 0.0005).alias("hard_fail"), F.when(k % 2 == 0, F.concat(F.lit("p"), k)).alias("active_promotion"))
    promotions = p.select("config_id", F.concat(F.lit("p"), k).alias("id"), F.concat(F.lit('s"'), k).alias("specification_id"), F.concat(F.lit("a\\"), k).alias("attempt_id"), F.concat(F.lit("m"), k).alias("measurement_path"), F.when(k % 2 == 0, "ACTIVE").otherwise("INVALIDATED").alias("status"))
    measurements = p.filter("p_partkey % 1000 <> 998").select(F.concat(F.lit("m"), k).alias("path"), F.sha2(k.cast("string"), 256).alias("raw_sha256"))
    return controls.config_digests(profiles, promotions, measurements, POLICY)


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    return e.select((F.col("event_id") % 3000).alias("id"), (F.col("user_id") % 3).alias("reviewer"), F.when(F.col("event_id") % 29 == 0, 1).otherwise(0).alias("packet"), F.when(F.col("event_type") == "error", "REJECT").otherwise("APPROVE").alias("verdict"))


def agg_quorum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.quorum(_reviews(spark, sf_dir))


def agg_polish_quorum(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _t(spark, sf_dir, "events").select((F.col("event_id") % 2000).alias("id"), (F.col("user_id") % 4).alias("reviewer"), F.col("event_type").alias("question"), F.when(F.col("value") > 150, "EDIT").otherwise("PASS").alias("answer"))
    return E.question_quorum(a, ["click", "view"])


def agg_worst_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_discount").alias("metric"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sample"))
    return E.worst_good(li, ["l_returnflag", "l_linestatus"], "metric", "sample")


C = f"WITH {T.CELLS}"
SQL = {
    "src_pairing": "SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing_sidecar' WHEN d.doc_id IS NULL THEN 'missing_raw' END AS reason FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)",
    "join_binding": "SELECT doc_id AS id, CASE WHEN doc_id % 17 = 0 THEN 'path_escape_raw' WHEN doc_id % 11 = 0 THEN 'missing_raw' WHEN doc_id % 7 = 0 THEN 'mismatch_raw' END AS reason FROM documents",
    "join_integrity": """WITH o AS (SELECT o_orderkey AS a, o_custkey AS k, sha256(CAST(o_orderkey AS VARCHAR)) AS sha FROM orders),
specs AS (SELECT 's' || c_custkey AS id, 'c' || c_custkey % 6 AS class, 'g' || c_custkey % 5 AS gate, CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 41 = 3 THEN 'p' || (c_custkey + 1) ELSE 'p' || c_custkey END AS active FROM customer),
proms AS (SELECT 'p' || k AS id, 's' || CASE WHEN k % 31 = 4 THEN -k ELSE k END AS spec, 'a' || CASE WHEN k % 37 = 5 THEN -a ELSE a END AS att, 'm' || CASE WHEN k % 43 = 6 THEN -a ELSE a END AS mpath, CASE WHEN k % 8 = 1 THEN 'PENDING' ELSE 'ACTIVE' END AS status FROM (SELECT k, min(a) AS a FROM o GROUP BY 1) WHERE k % 29 <> 2),
atts AS (SELECT 'a' || a AS id, 's' || CASE WHEN a % 47 = 7 THEN k + 1 ELSE k END AS spec, CASE WHEN a % 53 = 8 THEN 'discarded' ELSE 'retained' END AS state, CASE WHEN a % 7 = 1 THEN '' ELSE 'm' || a END AS mpath, CASE WHEN a % 59 = 9 THEN NULL ELSE 'v' || a END AS ppath, CASE WHEN a % 61 = 10 THEN NULL WHEN a % 67 = 11 THEN 'x' ELSE sha END AS sha, a % 1000 = 777 AS twice FROM o),
meas AS (SELECT 'm' || a AS path, 'c' || CASE WHEN a % 73 = 13 THEN 9 ELSE k % 6 END AS class, 'g' || CASE WHEN a % 79 = 14 THEN 9 ELSE k % 5 END AS gate, CASE WHEN a % 83 = 15 THEN 'y' ELSE sha END AS sha FROM o WHERE a % 71 <> 12),
provs AS (SELECT 'v' || a AS path, 'a' || CASE WHEN a % 97 = 17 THEN a + 1 ELSE a END AS att, 's' || CASE WHEN a % 101 = 18 THEN -k WHEN a % 47 = 7 THEN k + 1 ELSE k END AS spec, 'r' || a AS raw, CASE WHEN a % 103 = 19 THEN 'z' WHEN a % 107 = 20 THEN NULL ELSE sha END AS sha FROM o WHERE a % 89 <> 16),
files AS (SELECT 'r' || a AS path, sha FROM o WHERE a % 13 <> 11),
r AS (SELECT 'specification' AS kind, s.id, CASE WHEN s.active IS NULL THEN NULL WHEN p.id IS NULL THEN 'promotion broken_reference' WHEN p.spec <> s.id THEN 'promotion identity_specification' END AS why FROM specs s LEFT JOIN proms p ON p.id = s.active
UNION ALL SELECT 'promotion', p.id, CASE WHEN t.id IS NULL THEN 'attempt missing_attempt' WHEN s.id IS NULL THEN 'specification broken_reference' WHEN t.twice THEN 'attempt ambiguous' WHEN p.spec <> t.spec THEN 'attempt identity_specification' WHEN t.state = 'discarded' THEN 'attempt discarded_candidate' WHEN m.path IS NULL THEN 'measurement missing_file'
  WHEN m.gate <> s.gate THEN 'measurement identity_gate' WHEN m.class <> s.class THEN 'measurement identity_class' WHEN t.ppath IS NULL THEN 'provenance unnamed_file' WHEN v.path IS NULL THEN 'provenance missing_file' WHEN v.att <> p.att THEN 'provenance identity_attempt' WHEN v.spec <> t.spec THEN 'provenance identity_specification' WHEN f.path IS NULL THEN 'raw missing_file'
  WHEN v.sha IS NULL THEN 'provenance missing_hash' WHEN v.sha <> f.sha THEN 'provenance hash_mismatch' WHEN m.sha <> f.sha THEN 'measurement hash_mismatch' WHEN t.sha IS NULL THEN 'attempt missing_hash' WHEN t.sha <> f.sha THEN 'attempt hash_mismatch' END
  FROM proms p LEFT JOIN atts t ON t.id = p.att LEFT JOIN specs s ON s.id = p.spec LEFT JOIN meas m ON m.path = p.mpath LEFT JOIN provs v ON v.path = t.ppath LEFT JOIN files f ON f.path = v.raw
UNION ALL SELECT 'attempt', t.id, CASE WHEN t.twice THEN 'attempt ambiguous' WHEN t.mpath <> '' AND m.path IS NULL THEN 'measurement missing_file' WHEN f.path IS NOT NULL AND v.sha IS DISTINCT FROM f.sha THEN 'provenance hash_mismatch' WHEN f.path IS NOT NULL AND m.path IS NOT NULL AND m.sha <> f.sha THEN 'measurement hash_mismatch'
  WHEN t.sha <> f.sha THEN 'attempt hash_mismatch' WHEN t.ppath IS NOT NULL AND v.path IS NULL AND t.state = 'retained' THEN 'provenance missing_file' END FROM (SELECT * FROM atts UNION ALL SELECT * FROM atts WHERE twice) t LEFT JOIN meas m ON m.path = t.mpath LEFT JOIN provs v ON v.path = t.ppath LEFT JOIN files f ON f.path = v.raw WHERE t.id NOT IN (SELECT att FROM proms)
UNION ALL SELECT 'profile', f.class || '/' || f.gate, CASE WHEN p.id IS NULL THEN 'promotion missing_promotion' WHEN p.status <> 'ACTIVE' THEN 'promotion not_active' WHEN n > 1 THEN 'specification ambiguous' WHEN f.active IS DISTINCT FROM l THEN 'specification alternate_promotion' END FROM (SELECT class, gate, CASE WHEN id LIKE '%3' THEN 'p-1' ELSE active END AS active FROM specs) f
  LEFT JOIN proms p ON p.id = f.active LEFT JOIN (SELECT class, gate, count(*) AS n, min(active) AS l FROM specs GROUP BY ALL) q ON q.class = f.class AND q.gate = f.gate WHERE f.active IS NOT NULL)
SELECT kind, id, split_part(why, ' ', 1) AS hop, split_part(why, ' ', 2) AS reason FROM r""",
    "join_registered_attempt": """WITH o AS (SELECT *, sha256(CAST(o_custkey AS VARCHAR)) AS sha, CASE WHEN o_orderkey % 9 = 4 THEN 'edit' ELSE 'new' END AS mode FROM orders), l AS (SELECT sha, max(o_orderkey) AS last FROM o WHERE o_orderkey % 17 <> 3 GROUP BY 1)
SELECT 'a' || o_orderkey AS attempt_id, CASE WHEN o_orderkey % 17 = 3 THEN 'not_in_store' WHEN o_orderkey % 19 = 5 THEN 'digest_differs' WHEN o_orderstatus = 'F' THEN 'rejected' WHEN o_orderkey % 23 = 7 THEN 'no_provenance' WHEN o_orderkey % 7 = 2 AND mode <> 'new' THEN 'generation_mode_differs' WHEN o_orderkey % 29 = 8 THEN 'motion_class_differs'
  WHEN o_orderkey % 31 = 9 THEN 'prompt_sha256_differs' WHEN last <> o_orderkey THEN 'not_the_last' END AS reason FROM o LEFT JOIN l USING (sha)""",
    "join_bundle_replay": C + """, low AS (SELECT strip_id, frame, max(y) AS low FROM cells GROUP BY ALL), kept AS (SELECT c.strip_id, c.frame, x + CASE WHEN motion_class = 'swing' THEN 1 ELSE 0 END AS x, y - least(greatest(low - 4, 0), 3) AS y, x AS inn FROM cells c JOIN low USING (strip_id, frame) JOIN strips USING (strip_id)),
d AS (SELECT strip_id, min({'frame': frame, 'y': y, 'x': x}) AS m FROM kept WHERE inn < 6 AND y BETWEEN 0 AND 4 AND ((strip_id % 10 = 2 AND frame = 2) OR (strip_id % 10 = 4 AND frame = 3)) GROUP BY 1),
t AS (SELECT strip_id, min({'frame': 1, 'y': y, 'x': x}) AS m FROM cells WHERE strip_id % 10 = 3 AND frame = 3 GROUP BY 1),
n AS (SELECT strip_id, CAST(frame AS INT) AS frame, x, y, row_number() OVER (PARTITION BY strip_id ORDER BY frame, y, x) - 1 AS place FROM (SELECT strip_id, frame // 2 AS frame, x, y, rgb AS p FROM cells WHERE frame % 2 = 0) o FULL JOIN (SELECT strip_id, frame // 2 AS frame, x, y, rgb AS q FROM cells WHERE frame % 2 = 1) w USING (strip_id, frame, x, y) WHERE strip_id % 10 = 5 AND p IS DISTINCT FROM q)
SELECT strip_id AS bundle_id, CASE WHEN d.m IS NOT NULL THEN 'draft_reproduction_mismatch' WHEN t.m IS NOT NULL THEN 'cell_delta_replay_mismatch' WHEN n.place IS NOT NULL THEN 'invalid_cell_delta_ledger_noop' END AS reason, coalesce(d.m.frame, t.m.frame, n.frame) AS frame, coalesce(d.m.x, t.m.x, n.x) AS x, coalesce(d.m.y, t.m.y, n.y) AS y FROM strips LEFT JOIN d USING (strip_id) LEFT JOIN t USING (strip_id) LEFT JOIN (SELECT * FROM n WHERE place = 2) n USING (strip_id)""",
    "join_projection_eq": "SELECT p_partkey, f AS field FROM part, (VALUES ('p_brand'), ('p_size')) v(f) WHERE p_partkey % 31 = 4 OR (p_partkey % 9 = 0 AND f = 'p_size')",
    "join_divergence": "SELECT o_orderkey, o_orderstatus AS first, 'P' AS second FROM orders WHERE o_orderkey % 19 = 0 AND o_orderstatus <> 'P'",
    "join_contract": "SELECT o_orderkey AS id, state FROM (SELECT o_orderkey, CASE WHEN n IS NULL THEN 'pending' WHEN o_orderstatus = 'O' AND len(t) = 0 THEN 'agrees' WHEN o_orderstatus = 'F' AND (list_contains(t, 'A') OR list_contains(t, 'N')) THEN 'agrees' WHEN o_orderstatus = 'P' AND list_contains(t, 'R') AND (list_contains(t, 'A') OR list_contains(t, 'N')) THEN 'agrees' ELSE 'regression' END AS state FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, coalesce(list(DISTINCT l_returnflag) FILTER (l_tax > 0.07), []) AS t FROM lineitem WHERE l_orderkey % 10 <> 0 GROUP BY 1) ON l_orderkey = o_orderkey)",
    "fn_config_digest": r"""WITH g AS (SELECT p_type, p_brand, p_partkey AS k, '"g\u00e9' || p_partkey || '":{"active_promotion":' || CASE WHEN p_partkey % 2 = 0 THEN '"p' || p_partkey || '"' ELSE 'null' END || ',"budget":' || CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_partkey * 37 % 64 / 64.0::DOUBLE AS VARCHAR) ELSE 'null' END
  || ',"hard_fail":' || CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_partkey * 11 % 32 / 16.0::DOUBLE + 0.0005::DOUBLE AS VARCHAR) ELSE 'null' END || ',"status":"' || CASE WHEN p_partkey % 3 = 0 THEN 'UNSEPARATED' ELSE 'SEPARATED' END || '"}' AS t FROM part),
c AS (SELECT p_type, p_brand, '"' || p_brand || '":{' || string_agg(t, ',' ORDER BY 'gé' || k) || '}' AS t FROM g GROUP BY p_type, p_brand), a AS (SELECT p_type, '{' || string_agg(t, ',' ORDER BY p_brand) || '}' AS t FROM c GROUP BY 1),
p AS (SELECT p_type, string_agg('{"attempt_id":"a\\' || p_partkey || '","id":"p' || p_partkey || '","measurement_raw_sha256":"' || sha256(CAST(p_partkey AS VARCHAR)) || '","specification_id":"s\"' || p_partkey || '"}', ',' ORDER BY 'p' || p_partkey) FILTER (p_partkey % 2 = 0) AS t, bool_or(p_partkey % 1000 = 998) AS missing FROM part GROUP BY 1)
SELECT p_type AS config_id, CASE WHEN NOT missing THEN substr(sha256('{"acceptance_profiles":' || a.t || ',"active_promotions":[' || coalesce(p.t, '') || '],"numeric_policy":{"comparison":"metric <= budget","epsilon":0,"places":4,"rounding":"ceiling"}}'), 1, 16) END AS digest, CASE WHEN missing THEN 'missing_measurement' END AS reason FROM a JOIN p USING (p_type)""",
    "agg_quorum": "SELECT id, CASE WHEN reason IS NULL THEN 'ACTIVE' ELSE 'INVALIDATED' END AS status, reason FROM (SELECT event_id % 3000 AS id, CASE WHEN count(DISTINCT user_id % 3) < 2 THEN 'too_few_reviewers' WHEN count(DISTINCT event_id % 29 = 0) > 1 THEN 'packet_mismatch' WHEN bool_or(event_type = 'error') THEN 'not_approved' END AS reason FROM events GROUP BY 1)",
    "agg_polish_quorum": "SELECT id, needed, missing, open, CASE WHEN missing > 0 THEN 'INCOMPLETE' WHEN reviewers < needed THEN 'WAITING' WHEN open > 0 THEN 'UNRESOLVED' ELSE 'PASS' END AS status FROM (SELECT event_id % 2000 AS id, CASE WHEN count(*) FILTER (value > 150) > 0 THEN 2 ELSE 1 END AS needed, CAST(2 - count(DISTINCT event_type) FILTER (event_type IN ('click','view')) AS INT) AS missing, count(*) FILTER (value > 150) AS open, count(DISTINCT user_id % 4) AS reviewers FROM events GROUP BY 1)",
    "agg_worst_good": "SELECT l_returnflag, l_linestatus, max(l_discount) AS worst, min(l_orderkey * 10 + l_linenumber) FILTER (l_discount = top) AS binding, min(l_discount) AS floor FROM (SELECT *, max(l_discount) OVER (PARTITION BY l_returnflag, l_linestatus) AS top FROM lineitem) GROUP BY 1, 2",
}
QUERIES = {n: globals()[n] for n in SQL}
