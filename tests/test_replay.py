"""Slicing with margins, and drafts derived anew against what was stored."""

from framegauge.operators import grid, replay


def test_margins_and_gutters_are_no_cells(spark):
    sheet = spark.createDataFrame([(1, x, 0, x) for x in range(12)], "strip_id int, x int, y int, rgb int")
    got = {(r.frame, r.x): r.rgb for r in grid.slice_frames(sheet, 3, 1, 2).collect()}
    assert got == {(0, 0): 2, (0, 1): 3, (0, 2): 4, (1, 0): 6, (1, 1): 7, (1, 2): 8, (2, 0): 10, (2, 1): 11}


def test_a_changed_slice_rule_shows(spark):
    sheet = spark.createDataFrame([(1, 1 + f * 4 + x, y, 10 * f + x + y) for f in range(2) for x in range(3) for y in range(3)], "bundle_id int, x int, y int, rgb int")
    origins = spark.createDataFrame([(1, 2, 1)], "bundle_id int, origin_x int, origin_y int")
    stored = spark.createDataFrame([(1, f, x + 2, y + 1, 10 * f + x + y) for f in range(2) for x in range(3) for y in range(3)], "bundle_id int, frame int, x int, y int, rgb int")
    right = replay.provider_drafts(sheet, origins, 3, 1, 1, 3, 3, 3)
    assert replay.first_divergence(stored, right).collect() == []
    wrong = replay.provider_drafts(sheet, origins, 3, 1, 0, 3, 3, 3)
    assert [tuple(r) for r in replay.first_divergence(stored, wrong).collect()] == [(1, 0, 2, 1)]
    less = stored.filter("frame = 0 or x <> 3 or y <> 2")
    assert [tuple(r) for r in replay.first_divergence(less, right).collect()] == [(1, 1, 3, 2)]


def test_emptied_cells_are_replayed(spark):
    ledgers = spark.createDataFrame([(1, [0, 0])], "ledger_id int, mapping array<int>")
    base = spark.createDataFrame([(1, 0, 0, 0, 7), (1, 0, 1, 0, 8)], "ledger_id int, base int, x int, y int, rgb int")
    changed = spark.createDataFrame([(1, 0, 0, 0, [0, 0, 0, 0]), (1, 1, 2, 0, [1, 0, 2, 255])], "ledger_id int, frame int, x int, y int, after array<int>")
    got = {tuple(r) for r in replay.ledger_drafts(ledgers, base, changed).select("frame", "x", "y", "rgb").collect()}
    assert got == {(0, 1, 0, 8), (1, 0, 0, 7), (1, 1, 0, 8), (1, 2, 0, 65538)}
