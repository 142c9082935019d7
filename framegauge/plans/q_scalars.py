"""Queries of the scalar functions, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import gates
from ..sources import testdata as T

LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with a metric v in [0, 1), a second one u, and whether the gate is separated."""
    rows = T.table(spark, sf_dir, "lineitem")
    v = ((F.col("l_partkey") * 37 % 1009).cast("double") / 1009).alias("v")
    u = ((F.col("l_partkey") * 53 % 997).cast("double") / 997).alias("u")
    return rows.select("*", v, u)


def _key() -> list[Column]:
    return [F.col(c) for c in LINE]


L = "WITH l AS (SELECT *, CAST(l_partkey * 37 % 1009 AS DOUBLE) / 1009 AS v, CAST(l_partkey * 53 % 997 AS DOUBLE) / 997 AS u FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
CANON = "ceil(CAST({} AS DECIMAL(20,16)) * 10000)::DOUBLE / 10000"


def fn_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(*_key(), S.canonical("v").alias("canonical"))


def fn_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(*_key(), S.passes("v", "u").alias("passes"))


def fn_alpha_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = S.alpha_budget("v", "u")
    return _lines(spark, sf_dir).select(*_key(), b.alias("budget"), F.when(b.isNull(), "no_gap").alias("reason"))


def fn_legacy_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(*_key(), S.legacy_budget("v").alias("budget"))


def fn_tristate(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "A", "UNSEPARATED").otherwise("SEPARATED")
    return _lines(spark, sf_dir).select(*_key(), S.tristate("v", status, F.col("u"), F.col("u") + 0.25).alias("outcome"))


def fn_review_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("l_returnflag") == "R", "REVIEW").otherwise("FAIL")
    return _lines(spark, sf_dir).filter(S.review_band(outcome, "v", "u", F.col("u") + 0.25)).select(*_key(), "v", "u")


def fn_rgb_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("l_partkey") * 7919 % 16777216, F.col("l_suppkey") * 104729 % 16777216
    return _lines(spark, sf_dir).select(*_key(), S.rgb_distance(a, b).alias("d2"))


def fn_luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(*_key(), S.luma(F.col("l_partkey") * 7919 % 16777216).alias("luma"))


def fn_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("l_partkey") * 7919 % 16777216, F.col("l_suppkey") * 104729 % 16777216
    return _lines(spark, sf_dir).select(*_key(), F.floor(S.delta_e(a, b) * 1000 + 0.0005).alias("delta_e_1000"))


def fn_cheb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(*_key(), S.chebyshev(F.col("l_partkey") % 17 - 8, F.col("l_suppkey") % 13 - 6).alias("d"))


def fn_antisym(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.pairs import antisymmetric

    rows = _lines(spark, sf_dir).select(*_key(), (F.col("l_partkey") % 9 - 4).alias("p"), (F.col("l_partkey") % 7 - 3).alias("q"), (F.col("l_suppkey") % 9 - 4).alias("r"), (F.col("l_suppkey") % 5 - 2).alias("s"))
    return rows.select(*_key(), antisymmetric("p", "q", "r", "s").alias("opposite"))


def fn_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.element_at(F.array(F.lit("ISOLATED"), F.lit("NOT_ISOLATED"), F.lit("INDETERMINATE")), (F.col("l_partkey") % 3 + 1).cast("int"))
    return _lines(spark, sf_dir).select(*_key(), S.retention(verdict, F.col("l_tax") > 0.06, "l_linenumber").alias("artifact"))


def fn_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(*_key(), S.attempt_id("l_returnflag", "l_linestatus", "l_linenumber").alias("attempt_id"), F.concat_ws("/", "l_returnflag", "l_linestatus").alias("specification_id"))


def fn_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = T.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return docs.select("doc_id", "sha", S.is_digest("sha").alias("valid"), S.is_digest(F.upper("sha")).alias("upper_valid"))


def fn_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole thousandths, since powers of doubles differ in their last digit between engines."""
    n = F.col("l_partkey") % 30
    whole = lambda c, k: F.floor(c * k + 0.0005).cast("long")
    rows = T.table(spark, sf_dir, "lineitem").select(n.alias("n")).distinct()
    n = F.col("n")
    return rows.select("n", whole(S.hardness(n), 1000).alias("hardness"), whole(S.dig_rate(n), 1000).alias("dig_rate"), whole(S.smelt_rate(n), 1000).alias("smelter"), whole(S.unload_ms(n), 1000).alias("unload"), (n * 5 + 10).alias("carry"), (n * 5 + 20).alias("heap"))


def fn_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of each upgrade on the way to what a part owns; the hire costs the same each time."""
    rows = T.table(spark, sf_dir, "part").select("p_partkey", F.explode(F.sequence(F.lit(0), F.col("p_size") % 8)).alias("owned"), (F.col("p_brand") == "Brand#1").alias("hire"))
    return rows.select("p_partkey", "owned", S.upgrade_cost("owned", "hire").alias("cost"))


def fn_offline(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = F.when(F.col("event_id") % 10 == 0, None).when(F.col("event_id") % 10 == 1, float("nan")).otherwise(F.col("value") * 1000)
    away = S.offline_window(F.lit(300_000.0), saved)
    return T.table(spark, sf_dir, "events").select("event_id", away.alias("away"), (away >= 60_000).alias("summary"))


def fn_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, owned = (F.col("event_id") % 9).cast("double") * 1000, F.col("user_id") % 4
    return T.table(spark, sf_dir, "events").select("event_id", S.trip_leg(left, owned).alias("leg"), S.trip_progress(left, owned).alias("progress"))


def fn_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "events").select("event_id", S.damage_bucket(F.col("value") / 300).alias("state"))


def fn_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = spark.createDataFrame([(g, q, p) for g, (q, p) in gates.GATE_QUESTION.items()], "gate string, question string, panel string")
    names = list(gates.GATE_QUESTION) + ["dimension_parity"]
    e = T.table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*(F.lit(n) for n in names)), (F.col("user_id") % 6 + 1).cast("int")).alias("gate"))
    return e.join(F.broadcast(dim), "gate", "left").select("event_id", "gate", "question", "panel")


def fn_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed questions, and the class's own where it has any."""
    own = F.create_map(F.lit("walk"), F.array(F.lit("stride")), F.lit("swing"), F.array(F.lit("arc"), F.lit("contact")))
    asked = F.concat(F.array(F.lit("outline"), F.lit("colour")), F.coalesce(F.try_element_at(own, F.col("motion_class")), F.array().cast("array<string>")))
    return T.strips(spark, sf_dir).select("strip_id", F.array_join(asked, ",").alias("questions"))


def src_path_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*(F.lit(p) for p in ("prototype/strip-coherence/", "prototype/strip-coherence", "prototype/strip-coherence-x/", "other/prototype/strip-coherence/")))
    path = F.concat(F.element_at(kinds, (F.col("page_id") % 4 + 1).cast("int")), F.when(F.col("page_id") % 4 == 1, "").otherwise(F.col("page_id").cast("string")))
    return T.table(spark, sf_dir, "pages").select("page_id", S.legacy_path(path).alias("path"))


Q = "'" + "','".join(gates.GATE_QUESTION) + "','dimension_parity'"
QUESTION_ROWS = ",".join(f"('{g}','{q}','{p}')" for g, (q, p) in gates.GATE_QUESTION.items())


def _rgb(e: str) -> tuple[str, str, str]:
    return f"(({e}) // 65536)", f"(({e}) // 256 % 256)", f"(({e}) % 256)"


def _lab_sql(e: str) -> list[str]:
    lin = [f"(CASE WHEN {c} / 255.0::DOUBLE > 0.04045 THEN pow(({c} / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) ELSE {c} / 255.0::DOUBLE / 12.92::DOUBLE END)" for c in _rgb(e)]
    xyz = [f"(({lin[0]} * {a}::DOUBLE + {lin[1]} * {b}::DOUBLE + {lin[2]} * {c}::DOUBLE) / {w}::DOUBLE)" for a, b, c, w in ((0.4124, 0.3576, 0.1805, 0.95047), (0.2126, 0.7152, 0.0722, 1.0), (0.0193, 0.1192, 0.9505, 1.08883))]
    f = [f"(CASE WHEN {t} > 0.008856 THEN pow({t}, 1::DOUBLE / 3) ELSE {t} * 7.787::DOUBLE + 16.0::DOUBLE / 116 END)" for t in xyz]
    return [f"({f[1]} * 116 - 16)", f"(({f[0]} - {f[1]}) * 500)", f"(({f[1]} - {f[2]}) * 200)"]


A_, B_ = "l_partkey * 7919 % 16777216", "l_suppkey * 104729 % 16777216"
GAP = f"CASE WHEN u > v AND {CANON.format('v + (u - v) * 0.5')} >= v AND {CANON.format('v + (u - v) * 0.5')} < u THEN {CANON.format('v + (u - v) * 0.5')} END"
SQL = {
    "fn_canonical": L + CANON.format("v") + " AS canonical FROM l",
    "fn_passes": L + CANON.format("v") + " <= u AS passes FROM l",
    "fn_alpha_budget": L + f"{GAP} AS budget, CASE WHEN ({GAP}) IS NULL THEN 'no_gap' END AS reason FROM l",
    "fn_legacy_budget": L + "(ceil(CAST(v AS DECIMAL(20,16)) * 100)::DOUBLE + 2) / 100 AS budget FROM l",
    "fn_tristate": L + f"CASE WHEN {CANON.format('v')} <= u THEN 'PASS' WHEN l_returnflag <> 'A' AND {CANON.format('v')} >= u + 0.25 THEN 'FAIL' ELSE 'REVIEW' END AS outcome FROM l",
    "fn_review_band": L + "v, u FROM l WHERE l_returnflag = 'R' OR (v > u AND v < u + 0.25)",
    "fn_rgb_dist": L + " + ".join(f"({a} - {b}) * ({a} - {b})" for a, b in zip(_rgb(A_), _rgb(B_), strict=True)) + " AS d2 FROM l",
    "fn_luma": L + "{} * 0.299::DOUBLE + {} * 0.587::DOUBLE + {} * 0.114::DOUBLE AS luma FROM l".format(*_rgb(A_)),
    "fn_lab": L + "CAST(floor(sqrt(" + " + ".join(f"pow({a} - {b}, 2)" for a, b in zip(_lab_sql(A_), _lab_sql(B_), strict=True)) + ") * 1000 + 0.0005) AS BIGINT) AS delta_e_1000 FROM l",
    "fn_cheb": L + "greatest(abs(l_partkey % 17 - 8), abs(l_suppkey % 13 - 6)) AS d FROM l",
    "fn_antisym": L + "greatest(abs(l_partkey % 9 - 4 + l_suppkey % 9 - 4), abs(l_partkey % 7 - 3 + l_suppkey % 5 - 2)) <= 1 AS opposite FROM l",
    "fn_retention": L + "CASE WHEN l_partkey % 3 <> 1 OR l_tax > 0.06 OR l_linenumber <= 3 THEN 'retained' ELSE 'discarded' END AS artifact FROM l",
    "fn_id": L + "l_returnflag || '--' || l_linestatus || '--' || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') AS attempt_id, l_returnflag || '/' || l_linestatus AS specification_id FROM l",
    "fn_sha": "SELECT doc_id, sha256(text) AS sha, regexp_full_match(sha256(text), '[0-9a-f]{64}') AS valid, regexp_full_match(upper(sha256(text)), '[0-9a-f]{64}') AS upper_valid FROM documents",
    "fn_curve": "SELECT n, CAST(floor(pow(1.15, n) * 1000.0 * 1000 + 0.0005) AS BIGINT) AS hardness, CAST(floor((n * 0.25 + 1) * 1000 + 0.0005) AS BIGINT) AS dig_rate, CAST(floor(pow(1.5, n) * 0.06 * 1000 + 0.0005) AS BIGINT) AS smelter, CAST(floor(4000.0 / (n * 0.5 + 1) * 1000 + 0.0005) AS BIGINT) AS unload, n * 5 + 10 AS carry, n * 5 + 20 AS heap FROM (SELECT DISTINCT l_partkey % 30 AS n FROM lineitem)",
    "fn_ladder": "SELECT p_partkey, CAST(i AS INT) AS owned, CASE WHEN p_brand = 'Brand#1' THEN 160.0::DOUBLE ELSE pow(2, i) * 5 END AS cost FROM part, range(8) t(i) WHERE i <= p_size % 8",
    "fn_offline": "SELECT event_id, away, away >= 60000 AS summary FROM (SELECT event_id, CASE WHEN event_id % 10 < 2 THEN 0::DOUBLE ELSE greatest(0, least(300000 - value * 1000, 28800000)) END AS away FROM events)",
    "fn_trip": "SELECT event_id, CASE WHEN l = 0 THEN NULL WHEN l > u + 2000 THEN 'out' WHEN l > 2000 THEN 'unload' ELSE 'back' END AS leg, CASE WHEN l <> 0 THEN 1 - l / (u + 4000) END AS progress FROM (SELECT event_id, CAST(event_id % 9 AS DOUBLE) * 1000 AS l, 4000::DOUBLE / (user_id % 4 * 0.5 + 1) AS u FROM events)",
    "fn_bucket": "SELECT event_id, CASE WHEN x < 0 OR x > 1 THEN NULL WHEN x < 0.25 THEN 'intact' WHEN x < 0.5 THEN 'chipped' WHEN x < 0.75 THEN 'cracked' ELSE 'crumbling' END AS state FROM (SELECT event_id, value / 300 AS x FROM events)",
    "fn_question": f"SELECT event_id, e.gate, question, panel FROM (SELECT event_id, [{Q}][user_id % 6 + 1] AS gate FROM events) e LEFT JOIN (VALUES {QUESTION_ROWS}) q(gate, question, panel) ON q.gate = e.gate",
    "fn_brief": f"WITH {T.CELLS} SELECT strip_id, 'outline,colour' || CASE motion_class WHEN 'walk' THEN ',stride' WHEN 'swing' THEN ',arc,contact' ELSE '' END AS questions FROM strips",
    "src_path_map": "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'corpus/strip-coherence/' || page_id WHEN 1 THEN 'corpus/strip-coherence' WHEN 2 THEN 'prototype/strip-coherence-x/' || page_id ELSE 'other/prototype/strip-coherence/' || page_id END AS path FROM pages",
}
QUERIES = {n: globals()[n] for n in SQL}
