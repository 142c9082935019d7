"""Queries of streams, file sources and sinks, and the SQL of their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import ledger
from ..sources import files
from ..sources import testdata as T
from ..sources.shared import folder
from ..streaming import streams as S
from .q_ledger import SQL as LEDGER_SQL


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stream_of(spark, f"{sf_dir}/events.parquet")


def st_bus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drain(S.valid_messages(_stream(spark, sf_dir), ["click", "view", "purchase"], 50).select("event_id", "event_type", "k"), "bus")


def st_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as offsets in catch-up windows of 400, 800 or 1200 ms."""
    rows = _stream(spark, sf_dir).select("event_id", (F.col("value") * 10).alias("at_ms"), ((F.col("user_id") % 3 + 1) * 400).cast("double").alias("window_ms"))
    return S.drain(S.late_cut(rows, "at_ms", "window_ms"), "late")


def st_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir).select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type", (F.col("value") > 100).alias("high"))
    return S.drain(S.changed_only(rows), "change")


def st_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folder(spark, "rolling")
    S.rolling(_stream(spark, sf_dir).select("event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value"), out, folder(spark, "progress"))
    return spark.read.parquet(out).select("event_id", "p50", "p95", "top")


def st_thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as sessions, event types as clips; sign-ups turn a session off (even ids) and on again."""
    control = F.when(F.col("event_type") == "signup", F.col("event_id") % 2 == 1)
    rows = _stream(spark, sf_dir).select(F.col("user_id").cast("long").alias("session"), F.col("event_type").alias("clip"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("event_id").cast("long").alias("event_id"), control.alias("enabled"))
    return S.drain(S.thinned(rows, 7200.0), "thin")


def st_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMddHH"))
    return S.ingest_once(_stream(spark, sf_dir).select(key.alias("attempt_id"), "event_id"), "attempt_id")


def st_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of each event under fixed budgets, with its user's run of failures, recorded batch by batch."""
    outcome = scalars.tristate(F.col("value") / 1000, F.lit("SEPARATED"), F.lit(0.1), F.lit(0.2))
    rows = _stream(spark, sf_dir).select(F.col("user_id").cast("long").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").cast("long").alias("event_id"), outcome.alias("outcome"))
    rows = rows.withColumn("code", F.when(F.col("outcome") == "FAIL", F.col("outcome")))
    out = folder(spark, "outcomes")
    S.record_batches(S.escalated(rows), out, folder(spark, "progress"))
    return spark.read.parquet(out).select("event_id", "outcome", "streak", "escalate")


def snk_append_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events").select((F.col("event_id") % 4000).alias("id"), "event_id")
    return ledger.append_once(e.filter("id % 3 = 0"), e, "id")


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.table(spark, sf_dir, "orders")
    outcome = F.when(F.col("o_orderstatus") == "O", "PASS").when(F.col("o_orderstatus") == "F", "FAIL").otherwise("REVIEW")
    return o.select("o_orderkey", F.sha2(F.col("o_totalprice").cast("string"), 256).alias("sha"), outcome.alias("outcome"))


def snk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "report")
    files.write_report(_reports(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("outcome").agg(F.count("*").alias("n"))


def snk_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reports(spark, sf_dir)
    there = r.filter("o_orderkey % 10 = 0").withColumn("sha", F.when(F.col("o_orderkey") % 20 == 0, F.reverse("sha")).otherwise(F.col("sha")))
    return files.releases(r, there, "o_orderkey").select("o_orderkey", "reason")


def _documents(spark: SparkSession, sf_dir: str) -> str:
    path = folder(spark, "reviews")
    la = T.table(spark, sf_dir, "labels").select(F.when(F.col("doc_id") % 3 != 0, F.col("doc_id").cast("string")).alias("review_id"), F.when(F.col("doc_id") % 5 == 0, "other").otherwise("review/1").alias("schema"), "quality")
    la.write.partitionBy("quality").json(path)
    return path


def src_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files.tagged_documents(spark, _documents(spark, sf_dir), "review_id string, schema string", ["review/1"])
    return rows.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


def src_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files.reviews(files.tagged_documents(spark, _documents(spark, sf_dir), "review_id string, schema string", ["review/1"]))
    return rows.select(F.col("review_id").startswith("part-").alias("from_file")).groupBy("from_file").agg(F.count("*").alias("n"))


def src_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.inventory(spark, _documents(spark, sf_dir)).filter(scalars.is_digest("sha256")).select("path", "sha256")


SQL = {
    "st_bus": "SELECT event_id, event_type, CAST(props ->> '$.k' AS INT) AS k FROM events WHERE event_type IN ('click','view','purchase') AND CAST(props ->> '$.k' AS INT) < 50",
    "st_late": "SELECT event_id, value * 10 AS at_ms, CAST((user_id % 3 + 1) * 400 AS DOUBLE) AS window_ms FROM events WHERE user_id % 3 = 0 OR value * 10 >= (user_id % 3 + 1) * 400 - 250",
    "st_change": LEDGER_SQL["win_change"],
    "st_rolling": f"SELECT event_id, p50, p95, top FROM ({LEDGER_SQL['win_rolling']})",
    "st_append": "SELECT user_id || '-' || strftime(ts, '%Y%m%d%H') AS attempt_id, min(event_id) AS event_id FROM events GROUP BY 1",
    "st_outcomes": """WITH o AS (SELECT *, CASE WHEN m <= 0.1 THEN 'PASS' WHEN m >= 0.2 THEN 'FAIL' ELSE 'REVIEW' END AS outcome FROM (SELECT *, ceil(CAST(value / 1000 AS DECIMAL(20,16)) * 10000)::DOUBLE / 10000 AS m FROM events)),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM o), s AS (SELECT event_id, outcome, i - coalesce(max(i) FILTER (outcome <> 'FAIL') OVER (PARTITION BY user_id ORDER BY i), 0) AS streak FROM n) SELECT event_id, outcome, streak, streak >= 3 AS escalate FROM s""",
    "snk_append_once": "SELECT event_id % 4000 AS id, min(event_id) AS event_id FROM events WHERE event_id % 4000 % 3 <> 0 GROUP BY 1",
    "snk_report": "SELECT CASE o_orderstatus WHEN 'O' THEN 'PASS' WHEN 'F' THEN 'FAIL' ELSE 'REVIEW' END AS outcome, count(*) AS n FROM orders GROUP BY 1",
    "snk_release": "SELECT o_orderkey, CASE WHEN o_orderkey % 20 = 0 THEN 'release_conflict' END AS reason FROM orders WHERE o_orderstatus = 'O'",
    "src_discover": "SELECT CASE WHEN doc_id % 5 = 0 THEN 'unknown_schema' ELSE 'ok' END AS reason, count(*) AS n FROM labels GROUP BY 1",
    "src_reviews": "SELECT doc_id % 3 = 0 AS from_file, count(*) AS n FROM labels GROUP BY 1",
}
QUERIES = {n: globals()[n] for n in [*SQL, "st_thin", "src_inventory"]}
