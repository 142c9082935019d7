"""Queries and operators that have no SQL twin, against loops."""

import hashlib
import itertools
import math
import random
from pathlib import Path

from pyspark.sql import functions as F

from framegauge.operators import grid, ledger, pairs
from framegauge.plans import catalog
from framegauge.sources import files
from framegauge.sources import testdata as T


def test_shifts_of_wide_frames_equal_brute_force(spark):
    rng = random.Random(9)
    sizes = [(100, 5), (64, 5), (33, 4), (100, 5)]
    frames = [{(x, y) for x in range(w) for y in range(h) if rng.random() < 0.3} for w, h in sizes]
    frames[3] = {(x + 3, y) for x, y in frames[0] if x + 3 < 100}
    cells = spark.createDataFrame([(1, f, x, y) for f, cs in enumerate(frames) for x, y in cs], "strip_id long, frame int, x int, y int")
    dims = spark.createDataFrame([(1, f, w, h) for f, (w, h) in enumerate(sizes)], "strip_id long, frame int, w int, h int")
    todo = [(1, a, b, 4) for a, b in itertools.permutations(range(4), 2)]
    table = spark.createDataFrame(todo, "strip_id long, a int, b int, anchor int")
    got = {(r.a, r.b): [(s.frac, s.dy, s.dx, s.changed, s.union) for s in r.scores] for r in pairs.shift_scores(table, pairs.masks(cells, dims), 4, 1).collect()}
    for _, a, b, anchor in todo:
        (w, h), want = sizes[a], []
        for dy, dx in itertools.product(range(-1, 2), range(-4, 5)):
            here = {c for c in frames[a] if c[1] < anchor}
            there = {(x, y) for x in range(w) for y in range(min(h, anchor)) if (x + dx, y + dy) in frames[b]}
            changed, union = len(here ^ there), len(here | there)
            want.append((changed / union if union else 0.0, dy, dx, changed, union))
        assert got[a, b] == sorted(want), (a, b)


def test_inventory_has_every_file(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for name, data in (("x.json", b"1"), ("a/y.bin", b"\x00\xff"), ("a/b/x.json", b"{}"), ("empty", b"")):
        (tmp_path / name).write_bytes(data)
    got = {(r.path, r.sha256) for r in files.inventory(spark, str(tmp_path)).collect()}
    assert got == {(str(p.relative_to(tmp_path)), hashlib.sha256(p.read_bytes()).hexdigest()) for p in Path(tmp_path).rglob("*") if p.is_file() and p.stat().st_size}


def test_inventory_query_has_digests(spark, sf_dir):
    rows = catalog.queries()["src_inventory"](spark, sf_dir).collect()
    assert rows and len({r.path for r in rows}) == len(rows) and all(len(r.sha256) == 64 for r in rows)


def _thinned(rows, gap):
    kept, last = set(), {}
    for user, at, i in sorted(rows):
        if user not in last or at - last[user] >= gap:
            kept.add((user, i))
            last[user] = at
    return kept


def test_thinning_query_equals_a_loop(spark, sf_dir):
    events = T.table(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), "event_id").collect()
    want = _thinned([(r.user_id, r.at, r.event_id) for r in events], 7200.0)
    assert {(r.user_id, r.event_id) for r in catalog.queries()["win_thin"](spark, sf_dir).collect()} == want


def _pitch(profile, least, most, step, phase_step=0.5, epsilon=0.15):
    """Score of every pitch and phase of one profile, by the rule in the operator's docstring."""
    lo, hi, total, peak = min(profile), max(profile), sum(profile.values()), max(profile.values())
    best = None
    for i in range(round((most - least) / step) + 1):
        pitch = least + i * step
        for j in range(math.ceil(pitch / phase_step)):
            phase, taken, hits, teeth = j * phase_step, {}, 0, 0
            for k in range(math.ceil((lo - phase) / pitch), math.floor((hi - phase) / pitch) + 1):
                place = phase + k * pitch
                if not lo + 0.5 < place < hi - 0.5:
                    continue
                near = [(profile.get(round(place) + d, 0), -d, round(place) + d) for d in (-1, 0, 1)]
                e, _, x = max(near)
                teeth, hits = teeth + 1, hits + (e > peak * epsilon)
                if e:
                    taken[x] = e
            if teeth:
                score = sum(taken.values()) / total * (hits / teeth)
                if best is None or score > best[0]:
                    best = (score, pitch, phase)
    return best


def test_pitch_search_equals_brute_force(spark):
    rng = random.Random(4)
    profiles = {i: {x: rng.randrange(50) + (300 if x % (4 + i) == i else 0) for x in range(40)} for i in range(4)}
    df = spark.createDataFrame([(i, x, e) for i, p in profiles.items() for x, e in p.items()], "image_id long, x int, energy long")
    for r in grid.pitch_search(df, 3.0, 7.0, 0.25).collect():
        score, pitch, phase = _pitch(profiles[r.image_id], 3.0, 7.0, 0.25)
        assert abs(r.score - score) < 1e-9 and (r.pitch, r.phase) == (pitch, phase), r.image_id


def test_pitch_query_equals_brute_force(spark, sf_dir):
    images = {}
    for r in grid.edge_profile(T.pixels(spark, sf_dir)).filter("image_id < 40").collect():
        images.setdefault(r.image_id, {})[r.x] = r.energy
    got = {r.image_id: r for r in catalog.queries()["grid_pitch"](spark, sf_dir).collect()}
    for i, profile in images.items():
        if sum(profile.values()):
            score, pitch, phase = _pitch(profile, 3.0, 6.0, 0.25)
            assert abs(got[i].score - score) < 1e-9 and (got[i].pitch, got[i].phase) == (pitch, phase), i


def test_leader_query_equals_brute_force(spark, sf_dir):
    strips = {}
    for r in T.cells(spark, sf_dir).collect():
        strips.setdefault(r.strip_id, []).append((r.frame, r.y, r.x, r.rgb))
    got = {}
    for r in catalog.queries()["agg_leader"](spark, sf_dir).collect():
        got.setdefault(r.strip_id, []).append((r.ord, r.rgb, r.cells))
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a.to_bytes(3, "big"), b.to_bytes(3, "big"), strict=True))
    for i, cells in strips.items():
        counts, first, clusters = {}, {}, []
        for f, y, x, c in cells:
            counts[c], first[c] = counts.get(c, 0) + 1, min(first.get(c, (99, 99, 99)), (f, y, x))
        for c in sorted(counts, key=lambda c: (-counts[c], first[c], c)):
            for cluster in clusters:
                if d2(c, cluster[0]) <= 32 * 32:
                    cluster.append(c)
                    break
            else:
                clusters.append([c])
        want = sorted((-sum(counts[c] for c in k), k[0]) for k in clusters)[:16]
        assert sorted(got[i]) == [(o, c, -n) for o, (n, c) in enumerate(want)], i


def test_rolling_numbers_equal_a_loop(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(2), float(t // 2), t, float(rng.randrange(100))) for t in range(900)]
    df = spark.createDataFrame(rows, "k long, at double, id long, v double")
    got = {r.id: (r.p50, r.p95, r.top, r.step) for r in ledger.rolling_stats(df, "k", ["at", "id"], "v", 40, "at").collect()}
    for k in (0, 1):
        ring, before = [], None
        for _, at, i, v in sorted(r for r in rows if r[0] == k):
            ring = [*ring, v][-40:]
            s = sorted(ring)
            assert got[i] == (s[math.ceil(0.5 * len(s)) - 1], s[math.ceil(0.95 * len(s)) - 1], s[-1], None if before is None else at - before)
            before = at
