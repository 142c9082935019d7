"""Delta ledgers: what a ledger says of itself, and faults far inside a long one."""

import pytest
from pyspark.sql import functions as F

from framegauge.operators import deltas as D


@pytest.fixture(scope="module")
def tables(spark):
    bases = spark.createDataFrame([(1, 0, 60, 60), (2, 0, 2, 2), (3, 0, 2, 2), (4, 0, 2, 2), (5, 0, 2, 2)], "ledger_id int, base int, w int, h int")
    cells = spark.createDataFrame([(2, 0, 0, 0, 5)], "ledger_id int, base int, x int, y int, rgb int")
    good = D.frame_digests(bases, cells, "base").groupBy("ledger_id").agg(F.collect_list("sha256").alias("digests")).withColumns({"schema": F.lit(D.SCHEMA), "target_count": F.lit(1), "mapping": F.array(F.lit(0))})
    rows = [(1, i, 0, i % 60, i // 60, [0, 0, 0, 0], [9, 9, 9, 255]) for i in range(3600)] + [(2, 0, 0, 0, 0, [0, 0, 5, 255], [0, 0, 0, 0])]
    return bases, cells, good, spark.createDataFrame(rows, "ledger_id int, place long, frame int, x int, y int, before array<int>, after array<int>").repartition(6)


def _reasons(tables, ledgers=None, deltas=None):
    bases, cells, good, rows = tables
    return {r.ledger_id: (r.reason and r.reason.removeprefix(D.PREFIX), r.place) for r in D.check_ledgers(ledgers or good, bases, cells, deltas or rows).collect()}


def test_sound_and_empty_ledgers(tables):
    assert _reasons(tables) == {i: (None, None) for i in range(1, 6)}


def test_what_a_ledger_says_of_itself(tables):
    _, _, good, _ = tables
    k = F.col("ledger_id")
    odd = good.withColumns({"digests": F.when(k == 1, None).when(k == 2, F.array(F.lit("0" * 64))).otherwise(F.col("digests")), "mapping": F.when(k == 3, None).when(k == 4, F.array(F.lit(1))).otherwise(F.col("mapping")), "target_count": F.when(k == 5, None).otherwise(1)})
    assert _reasons(tables, odd) == {1: ("digest", None), 2: ("base_frame_hash_mismatch", None), 3: ("mapping", None), 4: ("mapping", None), 5: ("target_count", None)}


def test_faults_inside_a_long_ledger(spark, tables):
    rows = tables[3]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        swapped = rows.withColumn("place", F.expr("case place when 1800 then 1801 when 1801 then 1800 else place end"))
        assert _reasons(tables, deltas=swapped)[1] == ("order", 1801)
        again = rows.unionByName(rows.filter("ledger_id = 1 and place = 7").withColumn("place", F.lit(3600).cast("long")))
        assert _reasons(tables, deltas=again)[1] == ("duplicate", 3600)
        colour = rows.withColumn("after", F.when(F.col("place") == 3000, F.array(F.lit(1), F.lit(256), F.lit(0), F.lit(255))).otherwise(F.col("after")))
        assert _reasons(tables, deltas=colour)[1] == ("alpha", 3000)
        null = rows.withColumn("x", F.when(F.col("place") == 2000, None).otherwise(F.col("x")))
        assert _reasons(tables, deltas=null)[1] == ("bounds", 2000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
