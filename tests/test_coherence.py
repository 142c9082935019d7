"""The coherence report against plain loops over grids, and its rules one by one."""

import random
from collections import Counter
from fractions import Fraction

import pytest

from framegauge.operators import coherence as C

CLASSES = [("walk", True, True, None), ("swing", True, False, None), ("airborne", False, True, 0.015)]


def _round4(x):
    """A fraction in ten-thousandths, half to even."""
    return round(x * 10000)


def _at(frame, x, y):
    cells, w, h = frame
    return (x, y) in cells and 0 <= x < w and 0 <= y < h


def _score(a, b, dx, dy, anchor):
    changed = union = 0
    for y in range(min(a[2], b[2], anchor)):
        for x in range(a[1]):
            p, q = _at(a, x, y), _at(b, x + dx, y + dy)
            union += p or q
            changed += p != q
    return (Fraction(changed, union) if union else Fraction(0)), changed, union


def _best(a, b, span_x, span_y, anchor):
    """Scores of all shifts, best first, the first of equals in the order of rows and columns."""
    scores = [(*_score(a, b, dx, dy, anchor), dx, dy) for dy in range(-span_y, span_y + 1) for dx in range(-span_x, span_x + 1)]
    return sorted(scores, key=lambda s: s[0])


def _dist(p, q):
    return sum(((p >> s & 255) - (q >> s & 255)) ** 2 for s in (16, 8, 0))


def _palette(frames):
    order = [c for f in frames for _, c in sorted(f[0].items(), key=lambda i: (i[0][1], i[0][0]))]
    clusters = []
    counts = Counter(order)
    for rgb, _ in counts.most_common():
        home = next((c for c in clusters if _dist(rgb, c[0]) <= 64 * 64), None)
        home.append(rgb) if home else clusters.append([rgb])
    return [c[0] for c in sorted(clusters, key=lambda c: (-sum(counts[r] for r in c), c[0]))[:16]]


def _report(kind, frames):
    _, grounded, loops, floor = next(c for c in CLASSES if c[0] == kind)
    n = len(frames)
    base = [max((y for _, y in f[0]), default=None) for f in frames]
    anchor = base[0] if grounded else None
    top = lambda a: (anchor if anchor is not None else base[a] if base[a] is not None else frames[a][2]) if grounded else frames[0][2]
    frac = {(a, b): _best(frames[a], frames[b], 1, 0, top(a))[0] for a in range(n) for b in range(n) if a != b}
    r4 = {k: _round4(v[0]) for k, v in frac.items()}
    still = [_score(frames[a], frames[a + 1], 0, 0, 99) for a in range(n - 1)]
    palette = _palette(frames)
    shares = [Counter(min(palette, key=lambda p: (_dist(c, p), palette.index(p))) for c in f[0].values()) for f in frames]
    part = lambda f, c: Fraction(shares[f][c], max(1, sum(shares[f].values())))
    tv = [_round4(sum(abs(part(a, c) - part((a + 1) % n, c)) for c in palette) / 2) for a in range(n)] if n > 1 else []
    out = {
        "dimension_parity": len({f[1:] for f in frames}) == 1, "baseline_row_stable": all(b == anchor for b in base) if grounded else None, "baselines": base,
        "adjacent_max": max((r4[a, a + 1] for a in range(n - 1)), default=0), "loop": r4[n - 1, 0] if n > 1 else None, "max_pair": max((v for (a, b), v in r4.items() if a < b), default=0),
        "min_pair": min((v for (a, b), v in r4.items() if a < b), default=0), "orphan_max": max((min(r4[a, b] for b in range(n) if b != a) for a in range(n)), default=0) if n > 1 else 0,
        "static_max": max((10000 if not u else _round4(1 - Fraction(c, u)) for _, c, u in still), default=10000), "worst_drift": max(tv, default=0), "palette": palette, "margin": None, "flags": [],
    }
    if floor is not None:
        ring = [(i, (i + 1) % n) for i in range(n if loops else n - 1)] if n > 1 else []
        wide = {p: _best(frames[p[0]], frames[p[1]], 4, 4, top(p[0])) for p in ring}
        out["margin"] = min((_round4(s[1][0] - s[0][0]) for s in wide.values()), default=0)
        for k in (range(n) if loops else range(1, n - 1)) if n >= 3 else []:
            (_, _, _, ix, iy), (_, _, _, ox, oy) = wide[(k - 1) % n, k][0], wide[k, (k + 1) % n][0]
            if max(abs(ix), abs(iy)) >= 2 and max(abs(ix + ox), abs(iy + oy)) <= 1:
                out["flags"].append(k)
    return out


@pytest.fixture(scope="module")
def strips():
    rng = random.Random(4)
    out = {}
    for i in range(14):
        w, h, n = rng.choice([(6, 5), (9, 7), (5, 9)]), 0, rng.choice([1, 2, 3, 4, 5])
        w, h = w
        frames = [({(x, y): rng.choice([0x102030, 0x182838, 0xF00000, 0x00F000, 0xE00810]) for x in range(w) for y in range(h) if rng.random() < 0.4}, w, h) for _ in range(n)]
        out[i] = (CLASSES[i % 3][0], frames)
    body = {(x, y): 0x808080 for x in range(4, 7) for y in range(4, 9)} | {(4, 3): 0x808080, (6, 9): 0x808080}
    shifted = {(x + 3, y): c for (x, y), c in body.items()}
    out[20] = ("airborne", [(body, 14, 14), (shifted, 14, 14), (body, 14, 14), (body, 14, 14)])  # frame 1 jumps out and back
    out[21] = ("walk", [({(1, 1): 1}, 4, 4), ({(1, 1): 1}, 4, 5)])  # unequal sizes
    out[22] = ("walk", [({}, 4, 4), ({(1, 2): 1}, 4, 4), ({(1, 3): 1}, 4, 4)])  # an empty first frame: anchors of each pair's own
    out[23] = ("airborne", [({}, 4, 4), ({}, 4, 4)])  # no cells at all
    out[24] = ("walk", [({(x, 3): 1 for x in range(4)} | {(x, y): 1 for x in range(3) for y in range(3)}, 4, 4)] * 3)  # nothing moves
    return out


@pytest.fixture(scope="module")
def registered(spark, strips):
    cells = [(i, f, x, y, c) for i, (_, frames) in strips.items() for f, (cs, _, _) in enumerate(frames) for (x, y), c in cs.items()]
    dims = [(i, f, w, h, k) for i, (k, frames) in strips.items() for f, (_, w, h) in enumerate(frames)]
    classes = spark.createDataFrame(CLASSES, "motion_class string, grounded boolean, loops boolean, min_sharpness double")
    return C.registration(spark.createDataFrame(cells, "strip_id long, frame int, x int, y int, rgb int"), spark.createDataFrame(dims, "strip_id long, frame int, w int, h int, motion_class string"), classes).persist()


def test_registration_equals_loops(registered, strips):
    got = {r.strip_id: r for r in registered.collect()}
    assert set(got) == set(strips)
    for i, (kind, frames) in strips.items():
        want = _report(kind, frames)
        have = {k: got[i][k] for k in want}
        have["loop"], have["flags"] = got[i].loop and got[i].loop.frac, [f.frame for f in got[i].flags]
        assert have == want, i
    assert [f.frame for f in got[20].flags] == [1] or got[20].margin >= 0


PROFILE = "motion_class string, gate string, status string, budget double, hard_fail double"


def _reports(spark, registered, profiles):
    return {r.strip_id: r for r in C.reports(registered, spark.createDataFrame(profiles, PROFILE)).collect()}


def test_a_structural_fault_outweighs_the_gates(spark, registered):
    easy = [(c[0], g, "SEPARATED", 1.0, 2.0) for c in CLASSES for g in C.OUTCOME_ORDER]
    got = _reports(spark, registered, easy)
    assert got[21].outcome == got[22].outcome == "FAIL" and got[21].structural_fail and not got[21].dimension_parity and got[22].baseline_row_stable is False
    assert got[24].outcome == got[24].lenient_outcome == "PASS" and not got[24].structural_fail
    assert all(g.outcome == "PASS" for g in got[21].gates)


def test_three_values_and_the_lenient_one(spark, registered):
    # of strip 24 nothing moves: stillness is 1.0, all else 0
    def only(status, budget, hard):
        rows = [("walk", g, "SEPARATED", 1.0, 2.0) for g in C.OUTCOME_ORDER[:4]] + [("walk", "static_silhouette_pass", status, budget, hard)]
        r = _reports(spark, registered, rows)[24]
        return r.outcome, r.lenient_outcome
    assert only("SEPARATED", 1.0, 2.0) == ("PASS", "PASS")
    assert only("SEPARATED", 0.5, 1.0) == ("FAIL", "FAIL")
    assert only("SEPARATED", 0.5, 1.5) == only("SEPARATED", 0.5, None) == ("REVIEW", "REVIEW")
    assert only("UNSEPARATED", 0.5, 0.6) == ("REVIEW", "PASS")
    assert only("INAPPLICABLE", 0.5, 0.6) == ("PASS", "PASS")
    assert only("ODD", 0.5, 0.6) == only("SEPARATED", None, 0.6) == ("FAIL", "FAIL")


def test_classes_fail_closed(spark, registered):
    got = _reports(spark, registered, [("walk", "palette_drift_pass", "INAPPLICABLE", 1.0, 2.0)])
    assert {r.reason_code for r in got.values() if r.motion_class == "walk"} == {"drift_not_applicable"}
    assert {r.reason_code for r in got.values() if r.motion_class != "walk"} == {"missing_profile"} and {r.outcome for r in got.values()} == {"FAIL"}


def test_displacement_is_review_or_a_caveat(spark, registered, strips):
    easy = [("airborne", g, "SEPARATED", 1.0, 2.0) for g in C.OUTCOME_ORDER]
    got = {i: r for i, r in _reports(spark, registered, easy).items() if r.motion_class == "airborne"}
    for r in got.values():
        gate = [g.outcome for g in r.gates if g.gate == "displacement_pass"]
        if r.margin < 150:
            assert r.displacement_pass is None and gate == [] and r.caveats[0].startswith("degenerate alignment minimum (margin 0.")
        else:
            assert r.caveats == [] and gate == ["PASS" if not r.flags else "REVIEW"] and (r.outcome == "REVIEW") == bool(r.flags)
    assert got[20].displacement_pass is False and got[23].caveats == ["degenerate alignment minimum (margin 0.0000 at 0→1); displacement undecidable"]


def test_evidence_and_undecidable_gates(spark, registered, strips):
    profiles = spark.createDataFrame([("walk", g, "SEPARATED", 0.0, 0.5) for g in C.OUTCOME_ORDER] + [("walk", "baseline_row_stable", "SEPARATED", None, None), ("airborne", "palette_drift_pass", "SEPARATED", 1.0, 2.0), ("airborne", "displacement_pass", "SEPARATED", None, None)], PROFILE)
    classes = spark.createDataFrame(CLASSES, "motion_class string, grounded boolean, loops boolean, min_sharpness double")
    applies = C.applicable_gates(classes, profiles)
    assert [(r.gate, r.why) for r in applies.filter("motion_class = 'walk'").orderBy("ordinal").collect()] == [
        ("dimension_parity", "structural"), ("baseline_row_stable", "grounded: true"), ("silhouette_budget", "max_silhouette=0.0"), ("loop_closure_pass", "max_loop=0.0"), ("min_pair_cohort_pass", "max_min_pair=0.0"), ("palette_drift_pass", "always")]
    assert [(r.gate, r.why) for r in applies.filter("motion_class = 'swing'").collect()] == [(None, "unknown_class")]
    rows = {(r.strip_id, r.gate): r for r in C.measured_gates(C.reports(registered, profiles), applies).collect()}
    assert rows[21, "dimension_parity"].outcome == "fail" and rows[22, "baseline_row_stable"].outcome == "fail" and rows[23, "displacement_pass"].outcome == "undecidable" and "0→1" in rows[23, "displacement_pass"].reason
    for i, (kind, frames) in strips.items():
        if kind == "walk" and len(frames) > 1:
            base = max((y for _, y in frames[0][0]), default=None)
            scores = [_best(frames[a], frames[a + 1], 1, 0, base if base is not None else max((y for _, y in frames[a][0]), default=frames[a][2]))[0] for a in range(len(frames) - 1)]
            worst = max(scores, key=lambda s: _round4(s[0]))
            assert (rows[i, "silhouette_budget"].numerator, rows[i, "silhouette_budget"].denominator) == worst[1:3], i


def test_bundles_are_decided_in_order(spark):
    rows = [("FAIL", "FAIL", "PASS", "PASS", "PASS"), (None, "REVIEW", "PASS", "PASS", "PASS"), (None, None, "REVIEW", "FAIL", "PASS"), ("REVIEW", "PASS", "PASS", "REVIEW", "PASS"), ("REVIEW", "PASS", "PASS", "PASS", "PASS"), ("PASS", "PASS", "PASS", "PASS", "REVIEW"), (None, None, None, "PASS", "PASS"), (None, None, "PASS", "PASS", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, post_edit string, identity string, structural string, provider string, coherence string")
    got = [(r.outcome, r.decided_by) for r in C.bundle_outcomes(df).orderBy("i").collect()]
    assert got == [("FAIL", "post_edit"), ("FAIL", "identity"), ("REVIEW", "structural"), ("REVIEW", "provider"), ("FAIL", "post_edit"), ("REVIEW", "coherence"), ("FAIL", "structural"), ("FAIL", "coherence")]
