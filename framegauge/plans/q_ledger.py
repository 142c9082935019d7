"""Queries of ledgers, windows, sorts and sets, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import ledger
from ..sources import testdata as T


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as attempts: ordinals that some conversations skip, predecessors that some rows lack, states."""
    c = T.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    ident = lambda turn: F.concat_ws("-", F.col("conv_id"), turn)
    last = F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn")).isNull()
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.select(
        "conv_id", "turn", "role", ident(F.col("turn")).alias("attempt_id"), (F.col("turn") + 1 + F.when((F.col("conv_id") % 7 == 0) & (F.col("turn") >= 2), 1).otherwise(0)).alias("ordinal"),
        F.when((F.col("conv_id") * 31 + F.col("turn")) % 13 != 0, ident(before)).alias("_p"), before.alias("_b"),
        F.when(last & (F.col("conv_id") % 5 != 0), "selected").otherwise("rejected").alias("state"),
    ).withColumn("predecessor", F.when(F.col("_b").isNotNull(), F.col("_p"))).drop("_p", "_b")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return ledger.placed(e, "user_id", ["ts", "event_id"]).withColumn("ordinal", F.col("place").cast("int")).drop("place")


def win_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.dense_violations(_attempts(spark, sf_dir), "conv_id", "turn", "ordinal").select("conv_id", "turn", "ordinal", "expected")


def win_alloc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as a ledger, and counters that are ahead of some, behind others, and know users without events."""
    users = T.table(spark, sf_dir, "customer").selectExpr("c_custkey as user_id", "cast(c_custkey * 7 % 200 as bigint) as counter")
    return ledger.next_ordinal(_events(spark, sf_dir), "user_id", "ordinal", "event_id", counters=users)


def win_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("code", F.when(F.col("event_type") != "signup", F.col("event_type")))
    return ledger.trailing_streak(rows, "user_id", ["ts", "event_id"], "code")


def win_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.chain_violations(_attempts(spark, sf_dir), "conv_id", "turn", "attempt_id", "predecessor", "state")


def win_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("user_id", "ordinal", "event_id", "event_type")
    return ledger.project_prefix(rows, "user_id", "ordinal", F.col("event_type") == "purchase").select("user_id", "ordinal", "event_id", "selected")


def win_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("high", F.col("value") > 100)
    return ledger.changes(rows, "user_id", ["ts", "event_id"], ["event_type", "high"]).select("event_id", "user_id", "event_type", "high")


def win_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return ledger.rolling_stats(e, "event_type", ["ts", "event_id"], "value", 120, "us").select("event_id", "p50", "p95", "top", "step")


def win_cum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offset at which each event of a user ends, in whole thousandths."""
    rows = _events(spark, sf_dir).withColumn("ms", F.floor(F.col("value") * 100 + 0.5).cast("long"))
    return ledger.running_sums(rows, "user_id", ["ordinal"], "ms", "ends").select("event_id", "ends")


def win_thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return ledger.thin(rows, "user_id", "at", "event_id", 7200.0)


def agg_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.percentiles(T.table(spark, sf_dir, "events"), "event_type", "value")



def join_asof_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame of a user's clip at each event: four frames of 120, 80, 100 and 60 ms that loop for even users."""
    clip = spark.createDataFrame([(0, 0, 120), (1, 120, 200), (2, 200, 300), (3, 300, 360)], "frame int, starts int, ends int")
    e = T.table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 2 == 0).alias("loops"), F.floor(F.col("value") * 10).cast("int").alias("ms"))
    at = F.when(F.col("loops"), F.pmod("ms", F.lit(360))).otherwise(F.least("ms", F.lit(359)))
    return e.withColumn("at", at).join(F.broadcast(clip), (F.col("at") >= F.col("starts")) & (F.col("at") < F.col("ends"))).select("event_id", "frame")


def top_fragile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five claims with the thinnest headroom of a budget over the good value."""
    rows = T.table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.max(F.col("l_discount") + F.col("l_partkey") % 7 / 1000).alias("good"), (F.max("l_discount") + 0.02 + F.max("l_partkey") % 11 / 500).alias("control"))
    rows = rows.withColumn("budget", S.alpha_budget("good", "control")).filter("budget is not null")
    head = F.floor((F.col("budget") - F.col("good")) * 100000 + 0.5).cast("long")
    return rows.select("l_partkey", head.alias("headroom")).orderBy("headroom", "l_partkey").limit(5)


def sort_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type in order of their whole value, ties by id."""
    e = T.table(spark, sf_dir, "events").withColumn("at", F.floor("value").cast("long"))
    return ledger.placed(e.select("event_id", "event_type", "at"), "event_type", ["at", "event_id"]).drop("at")


def sort_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed orders by class and key, with their place in each class."""
    o = T.table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return ledger.placed(o.select("o_orderpriority", "o_orderkey"), "o_orderpriority", ["o_orderkey"])


def set_palette_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of a strip and those of the common palette (every fourth red level)."""
    cells = T.cells(spark, sf_dir)
    common = cells.select("rgb").distinct().filter("rgb div 65536 % 64 = 0")
    strips = cells.select("strip_id").distinct()
    return cells.select("strip_id", "rgb").union(strips.crossJoin(F.broadcast(common))).distinct()


def set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without labels first, labels without documents then."""
    d, la = T.table(spark, sf_dir, "documents").select("doc_id"), T.table(spark, sf_dir, "labels").select("doc_id")
    return d.join(la, "doc_id", "left_anti").select("doc_id", F.lit("missing").alias("kind")).union(la.join(d, "doc_id", "left_anti").select("doc_id", F.lit("extra").alias("kind")))


def set_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order: line numbers that repeat, and holes before the last one."""
    rows = T.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.collect_set("l_linenumber").alias("s"), F.max("l_linenumber").alias("top"))
    holes = F.array_except(F.sequence(F.lit(1), F.col("top")), F.col("s"))
    return rows.select("l_orderkey", (F.col("n") - F.size("s")).alias("repeats"), F.size(holes).alias("holes"))



def snk_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    updates = T.table(spark, sf_dir, "lineitem").filter("l_linenumber = 6").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("status", F.lit("INVALIDATED"))
    updates = updates.unionByName(updates.filter("o_orderkey % 3 = 0").withColumn("status", F.lit("ACTIVE")))
    updates = updates.unionByName(T.table(spark, sf_dir, "customer").selectExpr("-1 - c_custkey as o_orderkey", "'ACTIVE' as status"))
    changed, refused = ledger.status_update(rows, updates, "o_orderkey")
    return changed.unionByName(refused, allowMissingColumns=True)



EV = "WITH ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ordinal FROM events) "
AT = """WITH t AS (SELECT conv_id, turn, role, conv_id || '-' || turn AS attempt_id, turn + 1 + CASE WHEN conv_id % 7 = 0 AND turn >= 2 THEN 1 ELSE 0 END AS ordinal,
 lag(conv_id || '-' || turn) OVER w AS before, CASE WHEN (conv_id * 31 + turn) % 13 <> 0 THEN lag(conv_id || '-' || turn) OVER w END AS predecessor,
 CASE WHEN lead(turn) OVER w IS NULL AND conv_id % 5 <> 0 THEN 'selected' ELSE 'rejected' END AS state, lead(turn) OVER w IS NULL AS islast FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) """
SQL = {
    "win_dense": AT + "SELECT * FROM (SELECT conv_id, turn, ordinal, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS expected FROM t) WHERE ordinal <> expected",
    "win_alloc": EV + "SELECT user_id, greatest(coalesce(most, 0), coalesce(c_custkey * 7 % 200, 0)) + 1 AS next_ordinal, predecessor FROM (SELECT user_id, max(ordinal) AS most, arg_max(event_id, ordinal) AS predecessor FROM ev GROUP BY 1) FULL JOIN (SELECT c_custkey, c_custkey AS user_id FROM customer) USING (user_id)",
    "win_streak": EV + """, c AS (SELECT *, CASE WHEN event_type <> 'signup' THEN event_type END AS code FROM ev), z AS (SELECT user_id, max(ordinal) AS top FROM c GROUP BY 1),
l AS (SELECT c.user_id, code AS last FROM c JOIN z ON c.user_id = z.user_id AND ordinal = top), b AS (SELECT c.user_id, max(ordinal) AS brk FROM c JOIN l USING (user_id) WHERE code IS DISTINCT FROM last GROUP BY 1)
SELECT user_id, last AS code, CASE WHEN last IS NULL THEN 0 ELSE top - coalesce(brk, 0) END AS streak, CASE WHEN last IS NULL THEN 0 ELSE top - coalesce(brk, 0) END >= 3 AS escalate FROM l JOIN z USING (user_id) LEFT JOIN b USING (user_id)""",
    "win_chain": AT + """SELECT conv_id, CASE WHEN count(DISTINCT attempt_id) < count(*) THEN 'duplicate_id' WHEN bool_or(predecessor IS DISTINCT FROM before) THEN 'predecessor_mismatch'
WHEN count(*) FILTER (state = 'selected') <> 1 THEN 'not_one_selected' WHEN bool_or(state = 'selected' AND NOT islast) THEN 'selected_not_last' END AS reason FROM t GROUP BY 1""",
    "win_project": EV + "SELECT ev.user_id, ordinal, event_id, ordinal = upto AS selected FROM ev JOIN (SELECT user_id, max(ordinal) AS upto FROM ev WHERE event_type = 'purchase' GROUP BY 1) USING (user_id) WHERE ordinal <= upto",
    "win_change": EV + "SELECT event_id, user_id, event_type, high FROM (SELECT *, value > 100 AS high, lag(event_type || (value > 100)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM ev) WHERE b IS NULL OR b <> event_type || high",
    "win_rolling": "SELECT event_id, quantile_disc(value, 0.5) OVER w AS p50, quantile_disc(value, 0.95) OVER w AS p95, max(value) OVER w AS top, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS step FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)",
    "win_cum": EV + "SELECT event_id, CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ordinal) AS BIGINT) AS ends FROM ev",
    "agg_percentile": "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS top FROM events GROUP BY 1",
    "join_asof_frame": "SELECT event_id, CASE WHEN a < 120 THEN 0 WHEN a < 200 THEN 1 WHEN a < 300 THEN 2 ELSE 3 END AS frame FROM (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN CAST(floor(value * 10) AS INT) % 360 ELSE least(CAST(floor(value * 10) AS INT), 359) END AS a FROM events)",
    "top_fragile": f"""WITH g AS (SELECT l_partkey, max(l_discount + (l_partkey % 7)::DOUBLE / 1000) AS good, max(l_discount) + 0.02 + (max(l_partkey) % 11)::DOUBLE / 500 AS control FROM lineitem GROUP BY 1),
b AS (SELECT *, ceil(CAST(good + (control - good) * 0.5 AS DECIMAL(20,16)) * 10000)::DOUBLE / 10000 AS budget FROM g WHERE control > good)
SELECT l_partkey, CAST(floor((budget - good) * 100000 + 0.5) AS BIGINT) AS headroom FROM b WHERE budget >= good AND budget < control ORDER BY headroom, l_partkey LIMIT 5""",
    "sort_events": "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY floor(value), event_id) AS place FROM events",
    "sort_failures": "SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS place FROM orders WHERE o_orderstatus = 'F'",
    "set_palette_union": f"WITH {T.CELLS} SELECT DISTINCT strip_id, rgb FROM cells UNION SELECT DISTINCT s.strip_id, c.rgb FROM strips s, cells c WHERE c.rgb // 65536 % 64 = 0",
    "set_diff": "SELECT doc_id, 'missing' AS kind FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'extra' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
    "set_unique": "SELECT l_orderkey, count(*) - count(DISTINCT l_linenumber) AS repeats, CAST(max(l_linenumber) - count(DISTINCT l_linenumber) AS INT) AS holes FROM lineitem GROUP BY 1",
    "snk_status": """WITH u AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linenumber = 6) SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey IN (SELECT k FROM u) THEN 'INVALIDATED' ELSE o_orderstatus END AS status, NULL AS reason FROM orders
UNION ALL SELECT k, NULL, CASE WHEN k NOT IN (SELECT o_orderkey FROM orders) THEN 'unknown_key' ELSE 'conflict' END FROM u WHERE k % 3 = 0 OR k NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT -1 - c_custkey, NULL, 'unknown_key' FROM customer""",
}
QUERIES = {n: globals()[n] for n in [*SQL, "win_thin"]}
