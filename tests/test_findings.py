"""Faults found on odd inputs and larger tables."""

import inspect
import math
import random
import shutil
import tempfile
from pathlib import Path

import duckdb
import pytest

from framegauge.operators import grid, pairs
from framegauge.plans import catalog
from framegauge.sources import testdata as T
from framegauge.streaming import streams as S
from test_loops import _pitch


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pixels_are_never_broadcast(spark, sf_dir):
    """Pixels are 1,024 rows to a row of the table, which the planner does not know."""
    assert "BroadcastExchange" not in _plan(grid.border_ratio(T.pixels(spark, sf_dir)))


def test_margins_of_equal_ratios_are_ties(spark):
    """3/10 - 2/10 rounds to less than 2/10 - 1/10, but is no less."""
    pair = lambda a, first, second: (1, a, a + 1, 8, [{"frac": c / 10, "dy": 0, "dx": i, "changed": c, "union": 10} for i, c in enumerate((first, second))])
    kind = "strip_id long, a int, b int, anchor int, scores array<struct<frac: double, dy: int, dx: int, changed: long, union: long>>"
    got = pairs.worst_pair(spark.createDataFrame([pair(2, 2, 3), pair(1, 1, 2), pair(0, 1, 4)], kind)).first()
    assert (got.worst_a, got.min_margin) == (1, 3 / 10 - 2 / 10)


@pytest.fixture(scope="module")
def short(spark, sf_dir, tmp_path_factory):
    """Strips of one to four frames."""
    to = tmp_path_factory.mktemp("short")
    e = T.table(spark, sf_dir, "embeddings")
    e.filter("vec_id % 4 <= vec_id div 4 % 4").coalesce(1).write.parquet(str(to / "parts"))
    shutil.copy(next(Path(to / "parts").glob("part-*.parquet")), to / "embeddings.parquet")
    return str(to)


@pytest.mark.parametrize("name", ["join_ledger_build", "join_ledger_check"])
def test_strips_that_end_early(spark, short, name):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{short}/embeddings.parquet'")
    df = catalog.queries()[name](spark, short)
    want = con.sql(f"select {', '.join(df.columns)} from ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


def test_rolling_over_batches_holds_no_key_in_python(spark):
    """Three batches out of order within, the second restarted after; no Python worker gets a key's rows."""
    assert "pandas" not in inspect.getsource(S.rolling) and "InPandas" not in inspect.getsource(S.rolling)
    rng = random.Random(8)
    rows = [(rng.choice("ab"), t // 2, t, float(rng.randrange(100))) for t in range(600)]
    base, want, rings = "file://" + tempfile.mkdtemp(prefix="stream-"), {}, {}
    for k, _, i, v in rows:
        ring = rings[k] = [*rings.get(k, []), v][-40:]
        s = sorted(ring)
        want[i] = (s[math.ceil(0.5 * len(s)) - 1], s[math.ceil(0.95 * len(s)) - 1], s[-1])
    kind = "event_type string, at long, event_id long, value double"
    for part in (rows[:30], rows[30:400], rows[400:]):
        rng.shuffle(part)
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{base}/in").selectExpr("event_type", "timestamp_seconds(at) as ts", "event_id", "value")
        S.rolling(stream, f"{base}/out", f"{base}/progress", 40)
    got = spark.read.parquet(f"{base}/out").collect()
    assert {r.event_id: (r.p50, r.p95, r.top) for r in got} == want and len(got) == len(rows)


def test_components_over_tiles_in_few_rounds(spark, monkeypatch):
    """A spiral, a comb and noise over many tiles, against a search; the old way took a round for each cell of a path."""
    spiral = {(0, 0)}
    x = y = 0
    for k, n in enumerate(m for m in range(64, 0, -4) for _ in (0, 1)):
        for _ in range(n):
            x, y = x + (1, 0, -1, 0)[k % 4], y + (0, 1, 0, -1)[k % 4]
            spiral.add((x, y))
    comb = {(x, y) for x in range(100) for y in range(40) if y == 39 or x % 2 == 0}
    rng = random.Random(3)
    frames = [spiral, comb, {(x, y) for x in range(70) for y in range(70) if rng.random() < 0.6}, {(x, y) for x in range(8) for y in range(8) if rng.random() < 0.5}]
    rounds, write = [], grid.cut
    monkeypatch.setattr(grid, "cut", lambda df, name: rounds.append(name) or write(df, name))
    rows = [(1, f, x, y) for f, cs in enumerate(frames) for x, y in cs]
    got = {(r.frame, r.x, r.y): r.component for r in grid.components(spark.createDataFrame(rows, "strip_id long, frame int, x int, y int")).collect()}
    want = {}
    for f, cs in enumerate(frames):
        for x, y in sorted(cs, key=lambda c: (c[1], c[0])):
            todo = [(x, y)] if (f, x, y) not in want else []
            while todo:
                i, j = todo.pop()
                if (i, j) in cs and (f, i, j) not in want:
                    want[f, i, j] = y * 2**20 + x
                    todo += [(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)]
    assert got == want and len(got) == len(rows) and len(rounds) < 30


def test_profile_shuffles_pixels_once_and_pitch_makes_no_row_a_grid(spark, sf_dir, monkeypatch):
    """As many tasks as pixels call for, which are not merged at run time."""
    monkeypatch.setattr(grid, "PIXELS_A_TASK", 10_000)
    pixels = T.pixels(spark, sf_dir)
    plan = _plan(grid.edge_profile(pixels))
    assert plan.count("Exchange ") == 1 and f", {-(-pixels.count() // 10_000)})" in plan
    assert "NestedLoop" not in _plan(grid.pitch_search(grid.edge_profile(pixels), 3.0, 6.0, 0.25))


def test_packs_broadcast_parameters_only(spark, sf_dir):
    """Palette and policy: what grows with the table goes by a shuffle."""
    assert _plan(catalog.queries()["join_pack"](spark, sf_dir)).count("BroadcastExchange") <= 2


def test_locks_make_no_row_a_place(spark, sf_dir):
    """A lock's places are compared in the frame's own row; ax was the column by which a row for each place was shuffled."""
    assert "ax#" not in _plan(catalog.queries()["join_registered"](spark, sf_dir))


def _same_grids(got, profiles, least, most, step):
    got = {r.image_id: (r.score, r.pitch, r.phase) for r in got}
    for i, p in profiles.items():
        score, *where = (sum(p.values()) > 0 and _pitch(p, least, most, step)) or (-1.0, least, 0.0)
        assert abs(got[i][0] - score) < 1e-9 and list(got[i][1:]) == where, i
    assert len(got) == len(profiles)


def test_pitch_query_tries_every_grid_of_the_search(spark, sf_dir):
    """Steps of 0.05 from 3 to 6, as in SURVEY: 61 pitches, not every fifth of them."""
    profiles = {}
    for r in grid.edge_profile(T.pixels(spark, sf_dir)).filter("image_id < 25").collect():
        profiles.setdefault(r.image_id, {})[r.x] = r.energy
    _same_grids(catalog.queries()["grid_pitch"](spark, sf_dir).filter("image_id < 25").collect(), profiles, 3.0, 6.0, 0.05)


def test_pitch_search_of_any_ends_and_narrow_pitches(spark, monkeypatch):
    """Neighbouring teeth that take one column, ties, columns left out, images of other ends, without energy or too narrow."""
    monkeypatch.setattr(grid, "TEETH_AT_ONCE", 1000)
    rng = random.Random(6)
    profiles = {i: {x: rng.choice([0, 0, 1, 5, 5, 40]) for x in range(i % 4, 30 + i % 3)} for i in range(12)}
    profiles |= {20: {x: 7 * (x % 3 == 0) for x in range(5, 90) if x % 7}, 21: {x: 0 for x in range(9)}, 22: {4: 9}, 23: {4: 9, 5: 1}, 24: {x: 1 for x in range(-8, 20)}}
    df = spark.createDataFrame([(i, x, e) for i, p in profiles.items() for x, e in p.items()], "image_id long, x int, energy long")
    for least, most, step in ((1.0, 3.0, 0.25), (3.0, 6.0, 0.05)):
        _same_grids(grid.pitch_search(df, least, most, step).coalesce(1).collect(), profiles, least, most, step)
