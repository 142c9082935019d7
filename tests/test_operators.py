"""Operators against brute force and published boundary values."""

import itertools
import random

from pyspark.sql import functions as F

from framegauge.functions import scalars as S
from framegauge.operators import grid, ledger, pairs

W = H = 6


def _strip(seed, n=4):
    rng = random.Random(seed)
    return [{(x, y): rng.choice([0x401020, 0x802040, 0xC03060]) for x in range(W) for y in range(H) if rng.random() < 0.4} for _ in range(n)]


def _tables(spark, strips):
    cells = [(s, f, x, y, c) for s, frames in enumerate(strips) for f, cs in enumerate(frames) for (x, y), c in cs.items()]
    frames = [(s, f, W, H, "walk") for s, fs in enumerate(strips) for f in range(len(fs))]
    return spark.createDataFrame(cells, "strip_id long, frame int, x int, y int, rgb int"), spark.createDataFrame(frames, "strip_id long, frame int, w int, h int, motion_class string")


def test_shift_search_equals_brute_force(spark):
    strips = [_strip(s) for s in range(3)] + [[{}, {(1, 1): 5}, {}, {}]]
    cells, frames = _tables(spark, strips)
    table = spark.createDataFrame([(s, 4, False, 4) for s in range(4)], "strip_id long, n int, loops boolean, anchor int")
    scores = pairs.shift_scores(pairs.adjacent(table), pairs.masks(cells, frames), 2, 2)
    got = {(r.strip_id, r.a): (r.dx, r.dy, r.changed, r["union"]) for r in pairs.best_shift(scores).collect()}
    for s, a in itertools.product(range(4), range(3)):
        p, q, best = strips[s][a], strips[s][a + 1], None
        for dy, dx in itertools.product(range(-2, 3), range(-2, 3)):
            there = {(x, y) for y in range(4) for x in range(W) if (x + dx, y + dy) in q and 0 <= y + dy < H}
            here = {c for c in p if c[1] < 4}
            changed, union = len(here ^ there), len(here | there)
            frac = changed / union if union else 0.0
            if best is None or frac < best[0]:
                best = (frac, dx, dy, changed, union)
        assert got[s, a] == best[1:], (s, a)


def test_shared_palette_equals_brute_force(spark):
    rng = random.Random(1)
    colours = [rng.randrange(1 << 24) & 0xE0E0E0 for _ in range(14)]
    cells = [(0, 0, i % 20, i // 20, rng.choice(colours)) for i in range(200)]
    df = spark.createDataFrame(cells, "strip_id long, frame int, x int, y int, rgb int")
    got = [(r.rgb, r.cells) for r in grid.shared_palette(df, 70, 4).orderBy("ord").collect()]
    counts, first = {}, {}
    for _, f, x, y, c in cells:
        counts[c] = counts.get(c, 0) + 1
        first[c] = min(first.get(c, (9, 9, 99)), (f, y, x))
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a.to_bytes(3, "big"), b.to_bytes(3, "big"), strict=True))
    clusters = []
    for c in sorted(counts, key=lambda c: (-counts[c], first[c], c)):
        for cluster in clusters:
            if d2(c, cluster[0]) <= 70 * 70:
                cluster.append(c)
                break
        else:
            clusters.append([c])
    want = sorted(((-sum(counts[c] for c in k), k[0]) for k in clusters))[:4]
    assert got == [(c, -n) for n, c in want]


def test_pitch_search_finds_a_grid(spark):
    profile = [(1, x, 100 if x % 5 == 2 else 3) for x in range(60)] + [(2, x, 0) for x in range(10)]
    got = {r.image_id: r for r in grid.pitch_search(spark.createDataFrame(profile, "image_id long, x int, energy long"), 4.0, 6.0, 0.5).collect()}
    assert (got[1].pitch, got[2].score) == (5.0, -1.0) and abs(got[1].phase - 2.0) <= 1.0


def test_thinning_keeps_what_a_loop_keeps(spark):
    rng = random.Random(3)
    rows = [(i % 3, float(rng.randrange(500)), i) for i in range(200)]
    got = {r.id for r in ledger.thin(spark.createDataFrame(rows, "k long, at double, id long"), "k", "at", "id", 30.0).collect()}
    want = set()
    for k in range(3):
        last = None
        for _, at, i in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            if last is None or at - last >= 30:
                want.add(i)
                last = at
    assert got == want


def test_boundary_tables(spark):
    df = spark.createDataFrame([(0.20, 0.2239, 0.3), (0.2239, 0.2239, 0.3), (0.25, 0.2239, 0.3), (0.3, 0.2239, 0.3), (0.35, 0.2239, 0.3)], "m double, b double, c double")
    assert [r[0] for r in df.select(S.tristate("m", F.lit("SEPARATED"), "b", "c")).collect()] == ["PASS", "PASS", "REVIEW", "FAIL", "FAIL"]
    assert [r[0] for r in df.select(S.tristate("m", F.lit("UNSEPARATED"), F.lit(0.3), "c")).collect()] == ["PASS", "PASS", "PASS", "PASS", "REVIEW"]
    gaps = spark.createDataFrame([(0.3977, 0.4294), (0.1026, 0.1371), (0.5652, 0.6067)], "g double, c double")
    assert [r[0] for r in gaps.select(S.alpha_budget("g", "c")).collect()] == [0.4136, 0.1199, 0.586]
    old = spark.createDataFrame([(v,) for v in (0.330, 0.337, 0.196, 0.103, 0.148, 0.273)], "v double")
    assert [r[0] for r in old.select(S.legacy_budget("v")).collect()] == [0.35, 0.36, 0.22, 0.13, 0.17, 0.30]
    assert spark.range(1).select(S.canonical(F.lit(0.2795))).first()[0] == 0.2795
    assert [r[0] for r in spark.range(5).select(S.upgrade_cost("id", F.lit(False))).collect()] == [5, 10, 20, 40, 80]


def test_mutation_of_one_frame_leaves_the_least_pair(spark):
    strips = [[{(0, 0): 1}, {(0, 0): 1}, {(5, 5): 1}, {(2, 2): 1}]]
    cells, frames = _tables(spark, strips)
    mirrored = grid.mutate(cells, W, H).filter("mutation = 'mirror'").drop("mutation")
    table = spark.createDataFrame([(0, 4, False, H)], "strip_id long, n int, loops boolean, anchor int")
    least = lambda c: pairs.best_shift(pairs.shift_scores(pairs.all_pairs(table), pairs.masks(c, frames), 1)).agg(F.min("frac")).first()[0]
    assert least(cells) == least(mirrored) == 0.0
