"""The segmented scan and what is built on it: one hot key over many ranges, against loops."""

import random

import pytest
from pyspark.sql import functions as F

from framegauge.operators import ledger


@pytest.fixture(scope="module", autouse=True)
def many_ranges(spark):
    """Small ranges are not merged here."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def table(spark):
    """Key 1 has nearly all rows, in runs that are longer than a range; a null key, and keys of one row."""
    rng = random.Random(2)
    rows, code = [], "a"
    for i in range(6000):
        code = rng.choice("ab") if rng.random() < 0.002 else code
        rows.append((1, i, code, rng.randrange(100)))
    rows += [(k, 0, None if k % 2 else "c", k) for k in range(2, 20)] + [(None, i, "n", 1) for i in range(50)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k int, at int, code string, n long").repartition(8)


def _by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


def test_scan_equals_loops(spark, table):
    rows, df = table
    got = ledger.scanned(df, "k", ["at"], F.struct("code"), F.col("n")).collect()
    assert len(got) == len(rows)
    have = {(r.k, r.at): (r["_place"], r["_before"] and r["_before"].code if r["_before"] is not None else "first", r["_sum"]) for r in got}
    for k, own in _by_key(rows).items():
        total = 0
        for i, r in enumerate(own):
            total += r[3]
            assert have[k, r[1]] == (i + 1, own[i - 1][2] if i else "first", total)


def test_no_task_gets_the_whole_key(spark, table, monkeypatch):
    _, df = table
    seen = []
    plain = ledger.cut
    monkeypatch.setattr(ledger, "cut", lambda d, n: seen.append(plain(d, n)) or seen[-1])
    ledger.scanned(df, "k", ["at"]).count()
    most = seen[0].groupBy("_range").count().agg(F.max("count")).first()[0]
    assert most < 6000 * 0.6


def test_streaks_changes_and_sums(spark, table):
    rows, df = table
    streaks = {r.k: (r.code, r.streak, r.escalate) for r in ledger.trailing_streak(df, "k", ["at"], "code").collect()}
    moved = {(r.k, r.at) for r in ledger.changes(df, "k", ["at"], ["code"]).collect()}
    sums = {(r.k, r.at): r.total for r in ledger.running_sums(df, "k", ["at"], "n", "total").collect()}
    for k, own in _by_key(rows).items():
        n = 0
        for r in reversed(own):
            if r[2] is None or r[2] != own[-1][2]:
                break
            n += 1
        assert streaks[k] == (own[-1][2], n, n >= 3)
        assert {a for key, a in moved if key == k} == {r[1] for i, r in enumerate(own) if not i or own[i - 1][2] != r[2]}
        assert sums[k, own[-1][1]] == sum(r[3] for r in own)


@pytest.mark.parametrize("many", [False, True])
def test_chains_and_prefixes(spark, monkeypatch, many):
    if many:
        monkeypatch.setattr(ledger, "BROADCAST_KEYS", 0)
    ids = lambda k, n: [(k, i, f"{k}-{i}", f"{k}-{i - 1}" if i else None, "rejected") for i in range(n)]
    end = lambda rows: rows[:-1] + [(*rows[-1][:4], "selected")]
    rows = end(ids(1, 3000)) + end(ids(2, 3)) + ids(3, 3) + end(ids(4, 3))[::-1]
    early, twice = end(ids(5, 3)), end(ids(6, 3))
    early = [(*early[0][:4], "selected"), *early[1:2], (*early[2][:4], "rejected")]
    twice[1] = (6, 1, "6-0", "6-0", "rejected")
    rows += early + twice + [(7, 0, "7-0", "7-9", "selected")]
    df = spark.createDataFrame(rows, "k int, at int, id string, before string, state string").repartition(5)
    got = {r.k: r.reason for r in ledger.chain_violations(df, "k", "at", "id", "before", "state").collect()}
    assert got == {1: None, 2: None, 3: "not_one_selected", 4: None, 5: "selected_not_last", 6: "duplicate_id", 7: "predecessor_mismatch"}
    prefix = ledger.project_prefix(df, "k", "at", F.col("state") == "selected").groupBy("k").agg(F.count("*").alias("n"), F.count_if("selected").alias("s"))
    assert {r.k: (r.n, r.s) for r in prefix.collect()} == {1: (3000, 1), 2: (3, 1), 4: (3, 1), 5: (1, 1), 6: (3, 1), 7: (1, 1)}


def test_counters_and_updates(spark):
    rows = spark.createDataFrame([("a", 1, "a1", 0), ("a", 3, "a3", 1), ("a", 3, "a3b", 2), ("b", 2, "b2", 0)], "k string, ordinal int, id string, at int")
    counters = spark.createDataFrame([("a", 7), ("b", 1), ("c", 4)], "k string, counter long")
    got = {r.k: (r.next_ordinal, r.predecessor) for r in ledger.next_ordinal(rows, "k", "ordinal", "id", "at", counters).collect()}
    assert got == {"a": (8, "a3b"), "b": (3, "b2"), "c": (5, None)}
    assert {r.k: r.next_ordinal for r in ledger.next_ordinal(rows, "k", "ordinal", "id").collect()} == {"a": 4, "b": 3}
    old = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "id int, status string")
    new = spark.createDataFrame([(1, "y"), (1, "y"), (2, "y"), (2, "z"), (9, "y")], "id int, status string")
    changed, refused = ledger.status_update(old, new, "id")
    assert sorted(tuple(r) for r in changed.collect()) == [(1, "y"), (2, "x"), (3, "x")] and sorted(tuple(r) for r in refused.collect()) == [(2, "conflict"), (9, "unknown_key")]
