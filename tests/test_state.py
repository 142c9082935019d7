"""Streams with typed state against loops, whole and stopped in the middle."""

import random
import tempfile

from pyspark.sql import functions as F

from framegauge.plans import catalog
from framegauge.sources import testdata as T
from framegauge.streaming import streams as S


def _thinned(rows, gap):
    """rows: (session, clip, at, event_id, enabled)."""
    kept, last, off = set(), {}, set()
    for session, clip, at, i, enabled in sorted(rows, key=lambda r: (r[2], r[3])):
        if enabled is not None:
            off.discard(session) if enabled else off.add(session)
            if not enabled:
                last = {k: v for k, v in last.items() if k[0] != session}
        elif session not in off and ((session, clip) not in last or at - last[session, clip] >= gap):
            last[session, clip] = at
            kept.add((session, clip, i))
    return kept


def test_thinning_with_controls_equals_a_loop(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").select("user_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), "event_id").collect()
    want = _thinned([(r.user_id, r.event_type, r.at, r.event_id, r.event_id % 2 == 1 if r.event_type == "signup" else None) for r in e], 7200.0)
    got = {tuple(r) for r in catalog.queries()["st_thin"](spark, sf_dir).select("session", "clip", "event_id").collect()}
    assert got == want and len(got) < len(e)


def test_a_session_that_is_turned_off_forgets(spark):
    rows = [(1, "a", 0.0, 0, None), (1, "a", 10.0, 1, None), (1, None, 20.0, 2, False), (1, "a", 25.0, 3, None), (1, None, 30.0, 4, True), (1, "a", 31.0, 5, None), (1, "a", 40.0, 6, None), (2, "a", 31.0, 7, None), (1, "b", 41.0, 8, None)]
    path = tempfile.mkdtemp(prefix="stream-") + "/rows"
    spark.createDataFrame(rows, "session long, clip string, at double, event_id long, enabled boolean").write.parquet("file://" + path)
    out = S.drain(S.thinned(S.stream_of(spark, "file://" + path), 60.0), "thin")
    assert {r.event_id for r in out.collect()} == {0, 5, 7, 8}


def test_a_restart_in_the_middle_gives_the_same_ledger(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(4), t, t, rng.choice(["PASS", "FAIL", "REVIEW"])) for t in range(200)]
    want, runs = {}, {}
    for key, _, i, outcome in rows:
        runs[key] = runs.get(key, 0) + 1 if outcome == "FAIL" else 0
        want[i] = (outcome, runs[key], runs[key] >= 3)
    base = "file://" + tempfile.mkdtemp(prefix="stream-")
    put = lambda part: spark.createDataFrame(part, "key long, at long, event_id long, outcome string").coalesce(1).write.mode("append").parquet(f"{base}/in")

    def run():
        stream = spark.readStream.schema("key long, at long, event_id long, outcome string").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        S.record_batches(S.escalated(stream.withColumn("code", F.when(F.col("outcome") == "FAIL", F.col("outcome")))), f"{base}/out", f"{base}/progress")

    put(rows[:70])
    run()
    put(rows[70:110])
    run()
    run()  # nothing new: nothing is recorded again
    put(rows[110:])
    run()
    got = spark.read.parquet(f"{base}/out").collect()
    assert {r.event_id: (r.outcome, r.streak, r.escalate) for r in got} == want and len(got) == len(rows)
