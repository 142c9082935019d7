"""Codes and clusters of whole-number vectors against a full search, and odd rows."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framegauge.llm import centroids, vector_codes
from framegauge.llm.vectors import largest_component

SCHEMA = "vec_id long, embedding array<float>, label int"


def _mean(rows):
    return [int(s) // len(rows) for s in np.sum(rows, axis=0, dtype=object)]


def _nearest(x, entries):
    d = [int(((np.array(x, object) - np.array(e, object)) ** 2).sum()) for e in entries]
    return min(range(len(d)), key=lambda i: (d[i], i)), min(d)


def _lloyd(x, entries, rounds):
    for _ in range(rounds):
        near = [_nearest(v, entries)[0] for v in x]
        entries = [_mean([v for v, c in zip(x, near, strict=True) if c == i]) if i in near else e for i, e in enumerate(entries)]
    return entries, [_nearest(v, entries) for v in x]


def _codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    """rows: (vec_id, vector, label) that take part. Gives the rows of the result by brute force."""
    x = [(i, [math.floor(scale * c) for c in v], g) for i, v, g in rows]
    size = len(x[0][1]) // parts
    first = sorted(x, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda v, p: v[p * size : (p + 1) * size]
    found = [_lloyd([cut(v, p) for _, v, _ in x], [cut(v, p) for _, v, _ in first], rounds) for p in range(parts)]
    digest = hashlib.sha256(",".join(str(c) for entries, _ in found for e in entries for c in e).encode()).hexdigest()
    errors = [sum(near[k][1] for _, near in found) for k in range(len(x))]
    return [(i, "".join(f"{near[k][0]:02x}" for _, near in found), errors[k], sum(e for e, (_, _, h) in zip(errors, x, strict=True) if h == g), digest) for k, (i, _, g) in enumerate(x)]


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def _vectors(seed, n, width, ties=False):
    rng = np.random.Generator(np.random.PCG64(seed))
    x = rng.integers(-3, 4, (n, width)) / 1024 if ties else rng.standard_normal((n, width)) + rng.integers(0, 4, (n, 1)) * 3
    return [(i, [float(np.float32(c)) for c in v], None if i % 7 == 0 else i % 3) for i, v in enumerate(x)]


@pytest.mark.parametrize("ties", [False, True])
def test_codes_equal_a_full_search(spark, ties):
    rows = _vectors(5, 120, 8, ties)
    got = vector_codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(3), entries=12, width=8)
    assert _sorted(got.collect()) == _sorted(_codes(rows, entries=12))


def test_codes_of_odd_rows(spark):
    rows = _vectors(9, 40, 8)
    odd = [(None, rows[3][1], 1), (5, rows[5][1], 2), (5, rows[6][1], None)]  # a null id, a repeated row and a repeated id
    out = [(90, None, 1), (91, [None] * 8, 1), (92, [math.nan] * 8, 1), (93, [math.inf] * 8, 1), (94, [1.0] * 4, 1), (95, [], 1), (96, [3e38] * 8, 1)]
    df = spark.createDataFrame(rows + odd + out, SCHEMA).withColumns({"v": F.lit("x"), "codes": F.lit(1), "p": F.lit(2), "_label": F.lit(3)})
    assert _sorted(vector_codes.compress(df, entries=256).collect()) == _sorted(_codes(rows + odd))
    assert vector_codes.compress(df.filter("vec_id < 0")).collect() == []
    alone = vector_codes.compress(df.filter("vec_id = 1")).collect()
    assert [(r.code, r.error) for r in alone] == [("00000000", 0)]


def test_labels_by_salts(spark, monkeypatch):
    rows = _vectors(11, 50, 8)
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 1)
    assert _sorted(vector_codes.compress(spark.createDataFrame(rows, SCHEMA), entries=6).collect()) == _sorted(_codes(rows, entries=6))


def test_distances_beyond_doubles_are_exact():
    most = largest_component(64)
    x = np.array([[most] * 64, [-most] * 64, [most - 1] + [most] * 63])
    assert vector_codes.squared_distances(x, x)[0].tolist() == [0, 64 * 4 * most**2, 1]


def test_rings_leave_out_only_entries_that_cannot_win():
    rng = np.random.Generator(np.random.PCG64(1))
    entries, x = rng.integers(-50, 50, (40, 6)), rng.integers(-60, 60, (500, 6))
    codes = rng.integers(0, 40, 500)
    own = ((x - entries[codes]) ** 2).sum(axis=1)
    radius = np.sqrt([own[codes == i].max(initial=0) for i in range(40)])
    balls = vector_codes.Balls(entries, radius, np.zeros(40, bool))
    got, least = balls.reassign(x, codes, balls.neighbours())
    want = [_nearest(v, entries) for v in x]
    assert list(zip(got.tolist(), least.tolist(), strict=True)) == want
    # a second search from the right codes compares fewer entries: cores are not looked at
    tight = vector_codes._moved(balls, entries, np.array([least[got == i].max(initial=0) for i in range(40)]))
    assert tight.settled.all() and tight.reassign(x, got, tight.neighbours())[0].tolist() == got.tolist()


def _clusters(rows, k, rounds, scale=256):
    x = [(i, [math.floor(scale * c) for c in v]) for i, v in rows]
    order = sorted(x, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    entries, near = _lloyd([v for _, v in x], [v for _, v in order[:k]], rounds)
    digests = [hashlib.sha256(",".join(map(str, e)).encode()).hexdigest() for e in entries]
    return [(i, c, d, sum(e for b, e in near if b == c), sum(e for _, e in near), digests[c]) for (i, _), (c, d) in zip(x, near, strict=True)]


@pytest.mark.parametrize("ties", [False, True])
def test_clusters_equal_a_full_search(spark, ties):
    rows = [r[:2] for r in _vectors(3, 150, 6, ties)]
    scale = 1024 if ties else 256
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    assert _sorted(centroids.cluster(df, k=7, width=6, scale=scale).collect()) == _sorted(_clusters(rows, 7, 5, scale))


def test_clusters_of_odd_rows(spark):
    rows = [r[:2] for r in _vectors(4, 30, 6)]
    odd = [(None, rows[3][1]), (5, rows[5][1]), (5, rows[6][1])]
    out = [(90, None), (91, [None] * 6), (92, [math.nan] * 6), (93, [-math.inf] * 6), (94, [1.0] * 5), (95, []), (96, [3e38] * 6)]
    df = spark.createDataFrame(rows + odd + out, "vec_id long, embedding array<float>").withColumns({"v": F.lit("x"), "cluster": F.lit(1), "lead": F.lit(2)})
    assert _sorted(centroids.cluster(df, k=40, width=6).collect()) == _sorted(_clusters(rows + odd, 40, 5))
    assert centroids.cluster(df.filter("vec_id < 0"), width=6).collect() == []


def test_the_filter_measures_few_centroids(spark, monkeypatch):
    """On vectors near few lines most centroids are out by their bounds, and the result is that of a full search."""
    rng = np.random.Generator(np.random.PCG64(8))
    base = rng.standard_normal((20, 32)) * 4
    x = np.floor(256 * (base[rng.integers(0, 20, 400)] + rng.standard_normal((400, 32)) * 0.1)).astype(np.int64)
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<int>")
    rotation = centroids.fit_rotation(df, 32)
    assert rotation.leading < 16
    lead, rest = rotation.split(x)
    picked = x[:20]
    bounds = ((lead[:, None] - rotation.split(picked)[0][None]) ** 2).sum(axis=2) + (rest[:, None] - rotation.split(picked)[1][None]) ** 2
    exact = ((x[:, None] - picked[None]) ** 2).sum(axis=2)
    assert (bounds <= exact * (1 + 1e-9) + 1e-6).all()
    number, least = centroids.assign(x, lead.astype(np.float32).astype(float), rest.astype(np.float32).astype(float), picked, rotation)
    assert list(zip(number.tolist(), least.tolist(), strict=True)) == [_nearest(v, picked) for v in x]
