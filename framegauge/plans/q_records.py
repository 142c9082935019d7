"""Queries of evidence scans, snapshots and messages, and their SQL twins. Records are written as JSON from the tables first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import snapshots
from ..operators import review
from ..sources import records
from ..sources import testdata as T
from ..sources.shared import folder


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return T.table(spark, sf_dir, name)


def _lines(df: DataFrame, line: Column, name: str) -> str:
    """A folder with one line for each row."""
    path = folder(df.sparkSession, name)
    df.select(line.alias("value")).write.text(path)
    return path


def _json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields))


def src_json_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as documents with a tag; some tags are unknown, some missing, some documents broken."""
    e = _t(spark, sf_dir, "events")
    tag = F.when(F.col("event_id") % 7 != 0, F.when(F.col("event_id") % 5 == 0, "event/2").otherwise("event/1"))
    line = F.when(F.col("event_id") % 11 == 0, F.concat(F.lit('{"event_id": '), F.col("event_id"))).otherwise(_json(tag.alias("schema"), "event_id", "event_type"))
    rows = records.documents(spark, _lines(e, line, "tagged"), "schema string, event_id long, event_type string", ["event/1"], lines=True)
    return rows.select("event_id", "event_type", "reason")


def src_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as lines of an attempt ledger, with blank and broken lines, repeated ids and missing fields."""
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn")
    conv, turn = F.col("conv_id"), F.col("turn")
    ident = F.concat_ws("-", conv, F.when((conv % 11 == 0) & (turn == 1), 0).otherwise(turn))
    tag = F.when(conv % 13 == 0, "other/1").when(conv % 17 != 0, records.ATTEMPT_TAGS[0])
    line = _json(
        tag.alias("schema"), F.when(turn != 5, ident).alias("attempt_id"), F.when(turn % 7 == 3, "").otherwise(F.concat(F.lit("spec"), conv)).alias("specification_id"), F.when(turn > 0, turn).alias("ordinal"),
        F.lit("retained").alias("artifact_state"), F.lit("ISOLATED").alias("isolation"), F.when((conv + turn) % 23 == 0, "").alias("measurement_path"), F.when(conv % 29 != 0, "2026").alias("recorded_at"),
    )
    line = F.when((conv + turn) % 19 == 0, '{"schema": ').when((conv + turn) % 5 == 0, F.concat(F.lit("  \n"), line)).otherwise(line)
    return records.attempts(spark, _lines(c, line, "attempts")).select("attempt_id", "ordinal", "reason")


def src_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest for each user and hour, with an entry of both arrays for each event."""
    e = _t(spark, sf_dir, "events").withColumn("file", F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMddHH")))
    i = F.col("event_id")
    spec = F.struct(F.when(i % 97 != 0, F.concat_ws("/", "file", (i % 3).cast("string"))).alias("id"), F.when(i % 31 == 0, "").otherwise(F.col("event_type")).alias("motion_class"), F.lit("g").alias("target_gate"), F.when(i % 41 == 0, "").alias("active_promotion"))
    promotion = F.struct(F.when(i % 89 == 0, "").otherwise(F.concat_ws("/", "file", (i % 5).cast("string"))).alias("id"), F.lit("s").alias("specification_id"), F.lit("a").alias("attempt_id"), F.lit("m").alias("measurement_path"), F.when(i % 37 != 0, "ACTIVE").alias("status"), F.lit("2026").alias("recorded_at"))
    docs = e.groupBy("file").agg(F.collect_list(spec).alias("specifications"), F.collect_list(promotion).alias("promotions"))
    specs, promotions = records.manifest(spark, _lines(docs, _json(F.lit(records.MANIFEST_TAGS[0]).alias("schema"), "specifications", "promotions"), "manifests"))
    return specs.select(F.lit("specification").alias("kind"), "id", "reason").union(promotions.select(F.lit("promotion"), "id", "reason"))


def src_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile index for each part, with budgets that are numbers, texts or missing."""
    size = F.col("p_size")
    budget = F.when(size % 5 == 0, '"none"').otherwise((size / 64).cast("string"))
    hard = F.when(size % 3 == 0, '"0.5"').when(size % 7 == 0, "null").otherwise((size + 1).cast("string"))
    status = F.when(F.col("p_partkey") % 17 == 0, "").otherwise("SEPARATED")
    gate = F.concat(F.lit('{"status": "'), status, F.lit('", "budget": '), budget, F.lit(', "hard_fail": '), hard, F.when(F.col("p_partkey") % 23 == 0, F.lit(', "control_attempt": ""')).otherwise(F.lit("")), F.lit("}"))
    line = F.concat(F.lit(f'{{"schema": "{records.PROFILE_TAGS[0]}", "profiles": {{"c'), F.col("p_partkey"), F.lit('": {"gates": {"silhouette": '), gate, F.lit(', "loop": '), gate, F.lit("}}}}"))
    key = F.col("p_partkey")
    line = F.when(key % 31 == 1, F.substring(line, 1, 60)).when(key % 31 == 2, F.replace(line, F.lit("index/0"), F.lit("index/9"))).when(key % 31 == 3, '{"schema": "acceptance-profile-index/0", "profiles": {}}').otherwise(line)
    line = F.when(key % 31 == 4, F.concat(F.lit('{"schema": "acceptance-profile-index/0", "profiles": {"c'), key, F.lit('": {"gates": {}}}}'))).otherwise(line)
    return records.profiles(spark, _lines(_t(spark, sf_dir, "part"), line, "profiles")).select("motion_class", "gate", "budget", "hard_fail", "reason")


def src_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A measurement run for each order, with a gate for each line number."""
    li = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_discount").alias("metric"))
    gates = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("gate"), F.col("l_linenumber")), F.struct(F.lit("pass").alias("outcome"), "metric"))))
    o, key = _t(spark, sf_dir, "orders").select("o_orderkey").join(li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(gates.alias("gates")), "o_orderkey", "left"), F.col("o_orderkey")
    line = _json(
        F.when(key % 19 == 0, "x").otherwise(F.concat(F.lit("gate-control-measurement/"), key % 2)).alias("schema"), F.when(key % 13 != 0, F.concat(F.lit("sha"), key)).alias("raw_sha256"),
        F.when(key % 17 == 0, "").otherwise("walk").alias("motion_class"), F.lit("gate1").alias("target_gate"), F.lit("ISOLATED").alias("isolation"), F.when(key % 2 == 0, F.array(F.lit("c"))).alias("caveats"), "gates",
    )
    rows = records.measurements(spark, _lines(o, line, "measurements"))
    return rows.select("raw_sha256", "gate", "metric", F.size("caveats").alias("caveats"), "reason")


def src_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = _t(spark, sf_dir, "documents"), F.col("doc_id")
    line = _json(
        F.lit(records.PROVENANCE_TAGS[0]).alias("schema"), F.when(i % 7 != 0, "source").otherwise("").alias("specification_id"), F.concat(F.lit("a"), i).alias("attempt_id"),
        F.when(i % 11 != 0, F.concat(F.lit("raw/"), i)).alias("raw_path"), F.when(i % 9 == 0, "").otherwise(F.sha2("text", 256)).alias("raw_sha256"),
    )
    return records.provenance(spark, _lines(d, line, "provenance")).select("attempt_id", "raw_path", "raw_sha256", "reason")


def src_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lock specification for each part: two locks, a landmark and a limit, some of them wrong."""
    p, k = _t(spark, sf_dir, "part"), F.col("p_partkey")
    box = F.struct(F.when(k % 7 == 0, 5).otherwise(1).alias("x0"), F.lit(1).alias("y0"), F.lit(4).alias("x1"), F.lit(4).alias("y1"))
    one = F.struct(F.lit("head").alias("id"), box.alias("rectangle"), F.array(F.array(F.lit(0), F.lit(0)), F.array(F.lit(1), F.col("p_size"))).alias("permitted_offsets"), F.lit(None).cast("array<int>").alias("permitted_dx"), F.lit(None).cast("array<int>").alias("permitted_dy"), F.lit("exact-roles").alias("comparison"), F.lit(None).cast("double").alias("max_occupancy_difference"), F.lit(None).cast("double").alias("max_palette_role_distance"))
    spans = [F.sequence(F.lit(0), (F.col("p_size") % n).cast("int")) for n in (3, 2)]
    two = F.struct(F.when(k % 11 == 0, "").otherwise("feet").alias("id"), box.alias("rectangle"), F.lit(None).cast("array<array<int>>").alias("permitted_offsets"), spans[0].alias("permitted_dx"), spans[1].alias("permitted_dy"), F.when(k % 13 == 0, "other").otherwise("registered-structure").alias("comparison"), F.lit(0.5).alias("max_occupancy_difference"), F.when(k % 5 != 0, 0.25).alias("max_palette_role_distance"))
    mark = F.struct(F.lit("eye").alias("id"), F.when(k % 3 == 0, F.array(F.lit(2))).otherwise(F.array(F.lit(2), F.lit(3))).alias("canonical"), F.lit("skin").alias("palette_role"), F.lit(1).alias("max_distance"))
    limit = F.struct(F.array(F.lit("head"), F.when(k % 17 == 0, "tail").otherwise("feet")).alias("anchors"), F.lit(1).alias("max_dx_delta"), F.lit(2).alias("max_vertical_separation_delta"))
    doc = F.struct(F.array(one, two).alias("locks"), F.array(limit).alias("relational_constraints"), F.array(mark).alias("landmarks"))
    path = _lines(p, _json(F.lit("locks/1").alias("schema"), F.create_map(F.concat(F.lit("c"), k), doc).alias("motion_classes")), "locks")
    locks, marks, limits = records.lock_specs(spark, path, ["locks/1"])
    n, last = F.size("offsets"), F.element_at("offsets", -1)
    rows = locks.select("motion_class", F.lit("lock").alias("kind"), "id", n.alias("n"), last["dx"].alias("dx"), last["dy"].alias("dy"), "reason")
    rows = rows.union(marks.select("motion_class", F.lit("landmark"), "id", "most", "x", "y", "reason"))
    return rows.union(limits.select("motion_class", F.lit("limit"), "b", F.lit(0), "most_dx", "most_dy", "reason"))


def src_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pack for each conversation, an entry for each turn, and files for most of them."""
    c, conv, turn = _t(spark, sf_dir, "conversations"), F.col("conv_id"), F.col("turn")
    kind = F.when((conv % 9 == 0) & (turn == 1), "other").when(F.col("role") == "user", "animation").otherwise("static")
    frames = F.when(conv % 4 == 0, F.array(F.concat(F.lit("f"), turn), F.lit("f*"))).when(conv % 4 == 1, F.array(F.lit("g*"))).otherwise(F.array(F.concat(F.lit("f"), turn)))
    entry = F.struct("turn", F.struct(F.when((conv % 7 == 0) & (turn == 1), 0).otherwise(turn).cast("string").alias("id"), kind.alias("kind"), F.lit("walk").alias("animation"), F.when(conv % 10 == 3, "up").otherwise("left").alias("facing"), frames.alias("frames")).alias("e"))
    packs = c.groupBy(conv.alias("pack_id")).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]).alias("entries"))
    keys = c.filter((conv + turn) % 6 != 0).select(conv.alias("pack_id"), F.concat(F.lit("f"), turn).alias("key")).distinct()
    return records.pack_entries(packs, keys)


SNAPSHOT = {f: f"CASE WHEN o_orderkey % {n + 11} <> 0 THEN o_totalprice + {n} END" for n, f in enumerate(snapshots.FIELDS)}


def fn_upcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as snapshots of versions 0 to 7, each field missing in some of them."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 8).cast("int").alias("schemaVersion"), *(F.expr(e).alias(f) for f, e in SNAPSHOT.items()), F.expr("CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey END").alias("upgradeCount"))
    return snapshots.upcast(o)


def fn_msg_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages: of a type, a version, and for commands a name and an upgrade."""
    i = F.col("event_id")
    m = _t(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "click", "command").otherwise(F.col("event_type")).alias("type"), (1 + (i % 4 == 0).cast("int")).alias("schemaVersion"), F.element_at(F.array(*(F.lit(x) for x in ("buyUpgrade", "pause", "nothing"))), (i % 3 + 1).cast("int")).alias("command"), F.concat(F.lit("u"), i % 5).alias("upgrade"))
    commands = spark.createDataFrame([("buyUpgrade",), ("pause",)], "name string")
    catalogue = spark.createDataFrame([("u0",), ("u1",), ("u2",)], "id string")
    return snapshots.valid_messages(m, ["command", "view", "purchase"], 1, commands, catalogue)


def fn_record_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First rule that an order, as a record with digests, breaks."""
    i, sha = F.col("o_orderkey"), F.sha2(F.col("o_custkey").cast("string"), 256)
    o = _t(spark, sf_dir, "orders").select(i, F.when(i % 5 != 0, F.col("o_orderpriority")).otherwise("  ").alias("priority"), F.col("o_orderstatus").alias("status"), F.when(i % 7 == 0, F.upper(sha)).when(i % 11 != 0, sha).alias("raw_sha256"), F.when(i % 3 == 0, "short").when(i % 3 == 1, sha).alias("packet_sha256"))
    return o.select("o_orderkey", review.record_rules(["priority"], {"status": ["O", "F"]}, ["raw_sha256"], ["packet_sha256"]).alias("reason"))


def fn_second_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as gates of an order's run: outcomes by discount, first verdicts by flag."""
    li = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("gate"), F.when(F.col("l_discount") > 0.05, "REVIEW").otherwise("PASS").alias("outcome"), F.col("l_discount").alias("metric"), F.lit(0.02).alias("budget"), F.when(F.col("l_linenumber") != 2, F.lit(0.06)).otherwise(0.01).alias("hard_fail"), F.when(F.col("l_returnflag") == "N", "UNCERTAIN").when(F.col("l_returnflag") == "A", "APPROVE").alias("first_verdict"), (F.col("l_tax") > 0.07).alias("caveated"))
    rows = review.second_review_triggers(review.gates_in_review(li))
    return rows.select(F.col("run_id").alias("l_orderkey"), F.col("gate").alias("l_linenumber"), "metric", F.array_join("triggers", ",").alias("triggers"))


def _rules(*rules: tuple[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {r} THEN '{c}'" for r, c in rules) + " END"


_UP = {f: f"CASE WHEN v < {since} THEN {snapshots.BEFORE.get(f, 0.0)}::DOUBLE ELSE {'coalesce(' + (f) + ', 0)' if f in snapshots.OPTIONAL else ('CASE WHEN v = 1 THEN up ELSE ' + f + ' END' if f == 'digRateUpgradeCount' else f)} END" for f, since in snapshots.FIELDS.items()}
SQL = {
    "src_json_tagged": "SELECT CASE WHEN event_id % 11 <> 0 THEN event_id END AS event_id, CASE WHEN event_id % 11 <> 0 THEN event_type END AS event_type, " + _rules(("event_id % 11 = 0", "unreadable"), ("event_id % 7 = 0", "missing_schema"), ("event_id % 5 = 0", "unknown_schema")) + " AS reason FROM events",
    "src_attempts": """WITH l AS (SELECT *, conv_id || '-' || CASE WHEN conv_id % 11 = 0 AND turn = 1 THEN 0 ELSE turn END AS id, (conv_id + turn) % 19 = 0 AS bad FROM conversations),
a AS (SELECT *, CASE WHEN NOT bad AND turn <> 5 THEN id END AS attempt_id FROM l), t AS (SELECT *, count(attempt_id) OVER (PARTITION BY attempt_id) AS n FROM a)
SELECT attempt_id, CASE WHEN bad THEN 0 ELSE turn END AS ordinal, """ + _rules(("bad", "unreadable"), ("conv_id % 13 = 0", "unknown_schema"), ("conv_id % 17 = 0", "missing_schema"), ("attempt_id IS NULL", "missing_attempt_id"), ("n > 1", "duplicate_attempt_id"), ("turn % 7 = 3", "missing_specification_id"), ("(conv_id + turn) % 23 = 0", "empty_measurement_path"), ("conv_id % 29 = 0", "missing_recorded_at")) + " AS reason FROM t",
    "src_manifest": """WITH e AS (SELECT *, user_id || '-' || strftime(ts, '%Y%m%d%H') AS file FROM events), s AS (SELECT *, CASE WHEN event_id % 97 <> 0 THEN file || '/' || event_id % 3 END AS sid, CASE WHEN event_id % 89 = 0 THEN '' ELSE file || '/' || event_id % 5 END AS pid FROM e),
c AS (SELECT *, count(sid) OVER (PARTITION BY file, sid) AS sn, count(*) OVER (PARTITION BY file, pid) AS pn FROM s) SELECT 'specification' AS kind, sid AS id, """ + _rules(("sid IS NULL", "missing_id"), ("sn > 1", "duplicate_id"), ("event_id % 31 = 0", "missing_motion_class"), ("event_id % 41 = 0", "empty_active_promotion")) + " AS reason FROM c UNION ALL SELECT 'promotion', pid, " + _rules(("pid = ''", "missing_id"), ("pn > 1", "duplicate_id"), ("event_id % 37 = 0", "missing_status")) + " FROM c",
    "src_profiles": "SELECT 'c' || p_partkey AS motion_class, g AS gate, CASE WHEN p_size % 5 <> 0 THEN p_size::DOUBLE / 64 END AS budget, CASE WHEN p_size % 3 <> 0 AND p_size % 7 <> 0 THEN (p_size + 1)::DOUBLE END AS hard_fail, " + _rules(("p_partkey % 31 = 2", "unknown_schema"), ("p_partkey % 17 = 0", "missing_status"), ("p_partkey % 23 = 0", "empty_control_attempt")) + """ AS reason FROM part, (VALUES ('silhouette'), ('loop')) v(g) WHERE p_partkey % 31 NOT IN (1, 3, 4)
UNION ALL SELECT CASE WHEN p_partkey % 31 = 4 THEN 'c' || p_partkey END, NULL, NULL, NULL, CASE p_partkey % 31 WHEN 1 THEN 'unreadable' WHEN 3 THEN 'no_profiles' ELSE 'no_gates' END FROM part WHERE p_partkey % 31 IN (1, 3, 4)""",
    "src_measurements": """WITH g AS (SELECT l_orderkey, 'gate' || l_linenumber AS gate, max(l_discount) AS metric FROM lineitem GROUP BY ALL) SELECT CASE WHEN o_orderkey % 13 <> 0 THEN 'sha' || o_orderkey END AS raw_sha256, gate, metric, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS INT) AS caveats, """ + _rules(("o_orderkey % 19 = 0", "unknown_schema"), ("o_orderkey % 13 = 0", "missing_raw_sha256"), ("o_orderkey % 17 = 0", "missing_motion_class")) + " AS reason FROM orders LEFT JOIN g ON l_orderkey = o_orderkey",
    "src_provenance": "SELECT 'a' || doc_id AS attempt_id, CASE WHEN doc_id % 11 <> 0 THEN 'raw/' || doc_id END AS raw_path, CASE WHEN doc_id % 9 = 0 THEN '' ELSE sha256(text) END AS raw_sha256, " + _rules(("doc_id % 9 = 0", "missing_raw_sha256"), ("doc_id % 7 = 0", "missing_specification_id"), ("doc_id % 11 = 0", "missing_raw_path")) + " AS reason FROM documents",
    "src_locks": """WITH p AS (SELECT p_partkey AS k, p_size AS s, 'c' || p_partkey AS motion_class FROM part) SELECT motion_class, 'lock' AS kind, 'head' AS id, 2 AS n, 1 AS dx, CAST(s AS INT) AS dy, """ + _rules(("k % 7 = 0", "inverted_rectangle")) + """ AS reason FROM p
UNION ALL SELECT motion_class, 'lock', CASE WHEN k % 11 = 0 THEN '' ELSE 'feet' END, (s % 3 + 1) * (s % 2 + 1), s % 3, s % 2, """ + _rules(("k % 11 = 0", "missing_id"), ("k % 7 = 0", "inverted_rectangle"), ("k % 13 = 0", "unknown_comparison"), ("k % 5 = 0", "missing_threshold")) + """ FROM p
UNION ALL SELECT motion_class, 'landmark', 'eye', 1, 2, CASE WHEN k % 3 <> 0 THEN 3 END, """ + _rules(("k % 3 = 0", "bad_landmark")) + " FROM p UNION ALL SELECT motion_class, 'limit', CASE WHEN k % 17 = 0 THEN 'tail' ELSE 'feet' END, 0, 1, 2, " + _rules(("k % 17 = 0 OR k % 11 = 0", "unknown_anchor")) + " FROM p",
    "src_pack": """WITH c AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS INT) AS entry, CAST(CASE WHEN conv_id % 7 = 0 AND turn = 1 THEN 0 ELSE turn END AS VARCHAR) AS id, CASE WHEN conv_id % 9 = 0 AND turn = 1 THEN 'other' WHEN role = 'user' THEN 'animation' ELSE 'static' END AS kind FROM conversations),
d AS (SELECT *, count(*) OVER (PARTITION BY conv_id, id) AS n FROM c), f AS (SELECT *, 0 AS place, 'f' || turn AS wanted FROM d WHERE conv_id % 4 <> 1 UNION ALL SELECT *, 1, 'f*' FROM d WHERE conv_id % 4 = 0 UNION ALL SELECT *, 0, 'g*' FROM d WHERE conv_id % 4 = 1),
k AS (SELECT DISTINCT conv_id, 'f' || turn AS key FROM conversations WHERE (conv_id + turn) % 6 <> 0), j AS (SELECT f.*, k.key FROM f LEFT JOIN k ON k.conv_id = f.conv_id AND (k.key = wanted OR (wanted LIKE '%*' AND starts_with(k.key, rtrim(wanted, '*')))))
SELECT conv_id AS pack_id, entry, id, kind, place, wanted, key, """ + _rules(("kind = 'other'", "unknown_kind"), ("n > 1", "duplicate_id"), ("kind = 'animation' AND conv_id % 10 = 3", "unknown_facing"), ("wanted LIKE '%*' AND key IS NULL", "empty_prefix"), ("key IS NULL", "unknown_key")) + " AS reason FROM j",
    "fn_upcast": "WITH s AS (SELECT o_orderkey, CAST(o_orderkey % 8 AS INT) AS v, CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey END AS up, " + ", ".join(f"{e} AS {f}" for f, e in SNAPSHOT.items()) + " FROM orders), u AS (SELECT o_orderkey, v, " + ", ".join(f"CAST({e} AS DOUBLE) AS {f}" for f, e in _UP.items()) + " FROM s), r AS (SELECT *, " + _rules(("v NOT BETWEEN 1 AND 6", "unknown_version"), *((f"{f} IS NULL", f"missing_{f}") for f in snapshots.FIELDS)) + " AS reason FROM u) SELECT o_orderkey, CASE WHEN reason IS NULL THEN 6 END AS schemaVersion, " + ", ".join(f"CASE WHEN reason IS NULL THEN {f} END AS {f}" for f in snapshots.FIELDS) + ", reason FROM r",
    "fn_msg_valid": """WITH m AS (SELECT event_id, CASE WHEN event_type = 'click' THEN 'command' ELSE event_type END AS type, CAST(CASE WHEN event_id % 4 = 0 THEN 2 ELSE 1 END AS INT) AS schemaVersion, ['buyUpgrade','pause','nothing'][event_id % 3 + 1] AS command, 'u' || event_id % 5 AS upgrade FROM events)
SELECT * FROM m WHERE type IN ('command','view','purchase') AND schemaVersion = 1 AND (type <> 'command' OR command = 'pause' OR (command = 'buyUpgrade' AND upgrade IN ('u0','u1','u2')))""",
    "fn_record_valid": "SELECT o_orderkey, " + _rules(("o_orderkey % 5 = 0 OR trim(o_orderpriority) = ''", "missing_priority"), ("o_orderstatus NOT IN ('O','F')", "unknown_status"), ("o_orderkey % 7 = 0 OR o_orderkey % 11 = 0", "bad_digest_raw_sha256"), ("o_orderkey % 3 = 0", "bad_digest_packet_sha256")) + " AS reason FROM orders",
    "fn_second_review": """WITH g AS (SELECT *, count(*) FILTER (l_discount > 0.05) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) SELECT l_orderkey, l_linenumber, l_discount AS metric, concat_ws(',', CASE WHEN l_linenumber <> 2 AND l_discount >= (0.02::DOUBLE + 0.06::DOUBLE) / 2 THEN 'metric_at_or_beyond_midpoint' END,
CASE WHEN n >= 2 THEN 'multiple_gates_in_review' END, CASE WHEN l_returnflag = 'N' THEN 'first_verdict_uncertain' END, CASE WHEN l_tax > 0.07 THEN 'caveat_reliance' END) AS triggers FROM g""",
}
QUERIES = {n: globals()[n] for n in SQL}
