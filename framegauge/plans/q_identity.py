"""Queries of identity locks, continuity and part maps, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import locks as L
from ..operators import parts as P
from ..sources import testdata as T

PALETTE = [("stone", 0x204020), ("skin", 0x604020), ("cloth", 0xA04020), ("stone", 0xE04020)]
#: Two locks of every class: a box within one step both ways, and a row of roles that may move to the right.
HEAD = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
FEET = [(0, 0), (1, 0)]


def lock_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Locks, landmarks and limits of the motion classes."""
    as_rows = lambda offsets: [{"dx": dx, "dy": dy} for dx, dy in offsets]
    rows = [(c, k, *rest) for c in T.CLASSES for k, rest in enumerate((("head", 1, 1, 4, 3, as_rows(HEAD), "registered-structure", 0.7, 0.4), ("feet", 2, 6, 3, 6, as_rows(FEET), "exact-roles", None, None)))]
    locks = spark.createDataFrame(rows, "motion_class string, ord int, id string, x0 int, y0 int, x1 int, y1 int, offsets array<struct<dx: int, dy: int>>, comparison string, most_occupancy double, most_roles double")
    marks = spark.createDataFrame([(c, 0, "eye", 2, 2, "skin", 1) for c in T.CLASSES if c != "walk"], "motion_class string, ord int, id string, x int, y int, role string, most int")
    limits = spark.createDataFrame([(c, "head", "feet", 1, 1) for c in T.CLASSES], "motion_class string, a string, b string, most_dx int, most_dy int")
    return locks, marks, limits


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame 0 of each strip as the canonical one, all frames against it."""
    cells = T.cells(spark, sf_dir)
    canonical = cells.filter("frame = 0").select("strip_id", "x", "y", "rgb")
    return L.lock_scores(canonical, cells, T.frames(spark, sf_dir).select("strip_id", "frame", "motion_class"), lock_tables(spark)[0], PALETTE)


def join_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lock of every frame at every permitted offset: cells that are there, and that differ."""
    return _scores(spark, sf_dir).select("strip_id", "frame", "id", "dx", "dy", F.col("union").alias("places"), "changed")


def agg_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with both differences and whether the lock holds there."""
    return _scores(spark, sf_dir).select("strip_id", "frame", "id", "dx", "dy", "occupancy", "roles", "passed")


def _chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.choose_offsets(_scores(spark, sf_dir), lock_tables(spark)[2])


def agg_identity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.array_join(F.transform("locks", lambda c: F.concat_ws(":", c["id"], c["dx"].cast("string"), c["dy"].cast("string"))), ",")
    return _chosen(spark, sf_dir).select("strip_id", "frame", text.alias("offsets"), "passes", F.floor(F.col("score") * 1e6 + 0.25).cast("long").alias("score"))


def agg_identity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    locks, marks, _ = lock_tables(spark)
    chosen = _chosen(spark, sf_dir)
    return L.identity_report(chosen, L.landmark_results(chosen, T.cells(spark, sf_dir), marks, locks, PALETTE))


def agg_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each strip as an edit of the strip before, which counts as having two frames; key shares are those of its images."""
    cells, frames = T.cells(spark, sf_dir), T.frames(spark, sf_dir).select("strip_id", "frame", "motion_class")
    source = cells.filter("frame < 2").withColumn("strip_id", F.col("strip_id") + 1)
    source_frames = frames.filter("frame < 2").select((F.col("strip_id") + 1).alias("strip_id"), "frame")
    pixels = T.pixels(spark, sf_dir).withColumn("strip_id", F.expr("image_id div 4"))
    exact = ((F.col("r") == 255) & (F.col("g") == 0) & (F.col("b") == 255)).cast("double")
    shares = pixels.groupBy("strip_id").agg(F.avg(exact).alias("share"))
    wiped = L.key_wipe(shares, shares.withColumn("strip_id", F.col("strip_id") + 1), 0.01, 0.005)
    return L.continuity(cells, frames, source, source_frames, wiped, lock_tables(spark)[0], PALETTE, lock_tables(spark)[2])


def agg_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as figures in an upper and a lower part, with some cells claimed twice, not at all, or where none are."""
    c = T.cells(spark, sf_dir).withColumn("strip_id", F.col("strip_id") * 4 + F.col("frame"))
    i, y = F.col("strip_id"), F.col("y")
    cells = c.filter((i % 3 != 0) | F.col("x").between(2, 4)).select("strip_id", "x", "y", "rgb")
    upper = cells.filter((y < 4) | ((y == 4) & (i % 5 == 0))).withColumn("part", F.lit("upper"))
    lower = cells.filter((y >= 4) & ((i % 7 != 0) | (y < 7))).withColumn("part", F.lit("lower"))
    spare = cells.select("strip_id").distinct().filter("strip_id % 11 = 0").select("strip_id", F.lit(9).alias("x"), F.lit(9).alias("y"), F.lit(0).alias("rgb"), F.lit("lower").alias("part"))
    claims = upper.union(lower).union(spare).select("strip_id", "part", "x", "y")
    figures = cells.select("strip_id").distinct()
    parts = figures.filter("strip_id % 13 <> 0").select("strip_id", F.lit("upper").alias("part"), F.lit(None).cast("string").alias("parent"))
    parts = parts.union(figures.select("strip_id", F.lit("lower"), F.when(i % 17 == 0, "tail").otherwise("upper")))
    roles = cells.select("strip_id", "x", "y", L.role_of("rgb", PALETTE).alias("role"))
    return P.validate_parts(cells, claims, parts, ["upper", "lower"], [(3, 1, "upper")], "lower", [("cloth", ["upper"], ["lower"])], roles)


_PAL = " ".join(f"({i},'{r}',{c})," for i, (r, c) in enumerate(PALETTE)).rstrip(",")
_ROLE = "(SELECT arg_min(role, (rgb // 65536 - c // 65536) ** 2 * 10 + i) FROM (VALUES " + _PAL + ") v(i, role, c))"
_OFFS = ",".join(f"('head',{k},{dx},{dy})" for k, (dx, dy) in enumerate(HEAD)) + "," + ",".join(f"('feet',{k},{dx},{dy})" for k, (dx, dy) in enumerate(FEET))
_SHARES = " + ".join(f"abs(CASE WHEN np > 0 THEN p_{r} / np ELSE 0 END - CASE WHEN nq > 0 THEN q_{r} / nq ELSE 0 END)" for r in ("stone", "skin", "cloth"))


def _locks(canonical: str) -> str:
    """CTEs sc (scores) and best (combination of each frame), for canon(strip_id, frame, x, y, role)."""
    counts = ", ".join(f"count(*) FILTER ({s}.role = '{r}') AS {s}_{r}" for r in ("stone", "skin", "cloth") for s in ("p", "q"))
    return f"""pal AS (SELECT rgb, arg_min(role, (rgb // 65536 - c // 65536) ** 2 * 10 + i) AS role FROM (SELECT DISTINCT rgb FROM cells), (VALUES {_PAL}) v(i, role, c) GROUP BY 1),
rc AS (SELECT strip_id, frame, x, y, role FROM cells JOIN pal USING (rgb)), canon AS ({canonical}),
pl AS (SELECT 'head' AS id, CAST(i AS INT) AS x, CAST(j AS INT) AS y FROM range(1, 5) t(i), range(1, 4) u(j) UNION ALL SELECT 'feet', CAST(i AS INT), 6 FROM range(2, 4) t(i)), offs AS (SELECT * FROM (VALUES {_OFFS}) v(id, choice, dx, dy)),
sm AS (SELECT f.strip_id, f.frame, pl.id, choice, dx, dy, count(*) FILTER (p.role IS NOT NULL OR q.role IS NOT NULL) AS places, count(*) FILTER ((p.role IS NULL) <> (q.role IS NULL)) AS changed, count(*) FILTER (p.role <> q.role) AS other, count(p.role) AS np, count(q.role) AS nq, {counts}
 FROM fr f CROSS JOIN pl JOIN offs ON offs.id = pl.id LEFT JOIN canon p ON p.strip_id = f.strip_id AND p.frame = f.frame AND p.x = pl.x AND p.y = pl.y LEFT JOIN rc q ON q.strip_id = f.strip_id AND q.frame = f.frame AND q.x = pl.x + dx AND q.y = pl.y + dy GROUP BY ALL),
s0 AS (SELECT *, CASE WHEN places > 0 THEN changed / places ELSE 0 END AS occupancy, CASE WHEN id = 'head' THEN ({_SHARES}) * 0.5 ELSE 0 END AS roles FROM sm),
sc AS (SELECT *, CASE WHEN id = 'head' THEN occupancy <= 0.7 AND roles <= 0.4 ELSE changed = 0 AND other = 0 END AS passed FROM s0),
co AS (SELECT h.strip_id, h.frame, h.dx AS hx, h.dy AS hy, f.dx AS fx, f.dy AS fy, h.passed AS hp, f.passed AS fp, CAST(h.passed AS INT) + CAST(f.passed AS INT) AS passes, h.occupancy + h.roles + f.occupancy + f.roles + (abs(h.dx) + abs(h.dy) + abs(f.dx) + abs(f.dy)) * 0.000001::DOUBLE AS score, h.choice * 10 + f.choice AS ord
 FROM sc h JOIN sc f ON h.strip_id = f.strip_id AND h.frame = f.frame AND h.id = 'head' AND f.id = 'feet' WHERE abs(h.dx - f.dx) <= 1 AND abs(h.dy - f.dy) <= 1),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY strip_id, frame ORDER BY passes DESC, score, ord) AS rn FROM co) WHERE rn = 1)"""


_OWN = f"WITH {T.CELLS}, fr AS (SELECT strip_id, frame, motion_class FROM frames), " + _locks("SELECT c.strip_id, f.frame, x, y, role FROM rc c JOIN fr f ON f.strip_id = c.strip_id AND c.frame = 0")
_SOURCE = f"WITH {T.CELLS}, fr AS (SELECT strip_id, frame, motion_class FROM frames WHERE strip_id > (SELECT min(strip_id) FROM frames)), " + _locks("SELECT c.strip_id + 1 AS strip_id, f.frame, x, y, role FROM fr f JOIN rc c ON c.strip_id + 1 = f.strip_id AND c.frame = least(f.frame, 1)")
SQL = {
    "join_registered": _OWN + " SELECT strip_id, frame, id, dx, dy, places, changed FROM sc",
    "agg_identity": _OWN + " SELECT strip_id, frame, id, dx, dy, occupancy::DOUBLE AS occupancy, roles::DOUBLE AS roles, passed FROM sc",
    "agg_identity_search": _OWN + " SELECT strip_id, frame, 'head:' || hx || ':' || hy || ',feet:' || fx || ':' || fy AS offsets, passes, CAST(floor(score * 1000000.0::DOUBLE + 0.25) AS BIGINT) AS score FROM best",
    "agg_identity_report": _OWN + """, mk AS (SELECT b.strip_id, b.frame, min(q.x) IS NOT NULL AS found FROM best b JOIN fr f ON f.strip_id = b.strip_id AND f.frame = b.frame AND motion_class <> 'walk' LEFT JOIN rc q ON q.strip_id = b.strip_id AND q.frame = b.frame AND q.role = 'skin' AND abs(q.x - 2 - hx) <= 1 AND abs(q.y - 2 - hy) <= 1 GROUP BY ALL),
ff AS (SELECT strip_id, frame, 0 AS o, 'check' AS kind, 'head' AS id FROM best WHERE NOT hp UNION ALL SELECT strip_id, frame, 1, 'check', 'feet' FROM best WHERE NOT fp UNION ALL SELECT strip_id, frame, 2, 'landmark', 'eye' FROM mk WHERE NOT found),
fst AS (SELECT *, row_number() OVER (PARTITION BY strip_id ORDER BY frame, o) AS rn FROM ff)
SELECT d.strip_id, CASE WHEN f.id IS NULL THEN 'PASS' ELSE 'FAIL' END AS outcome, d.n AS frames, (SELECT count(DISTINCT frame) FROM ff WHERE ff.strip_id = d.strip_id) AS failed_frames, f.frame, f.kind, f.id FROM (SELECT strip_id, count(*) AS n FROM best GROUP BY 1) d LEFT JOIN fst f ON f.strip_id = d.strip_id AND rn = 1""",
    "agg_continuity": _SOURCE + f""", {T.PIXELS}, sh AS (SELECT image_id // 4 AS strip_id, avg(CASE WHEN r = 255 AND g = 0 AND b = 255 THEN 1.0 ELSE 0.0 END) AS share FROM pixels GROUP BY 1), wp AS (SELECT a.strip_id, a.share >= 0.01 AND b.share <= 0.005 AS wiped FROM sh a JOIN sh b ON b.strip_id = a.strip_id - 1),
ff AS (SELECT strip_id, frame, 0 AS o, 'head' AS id FROM best WHERE NOT hp UNION ALL SELECT strip_id, frame, 1, 'feet' FROM best WHERE NOT fp), fst AS (SELECT *, row_number() OVER (PARTITION BY strip_id ORDER BY frame, o) AS rn FROM ff)
SELECT d.strip_id, CASE WHEN wiped OR f.id IS NOT NULL THEN 'FAIL' ELSE 'PASS' END AS outcome, CASE WHEN wiped THEN 'provider_magenta_wipe' WHEN f.id IS NOT NULL THEN 'edit_source_continuity_fail' END AS reason, f.frame, f.id FROM (SELECT DISTINCT strip_id FROM best) d LEFT JOIN wp USING (strip_id) LEFT JOIN fst f ON f.strip_id = d.strip_id AND rn = 1 UNION ALL SELECT min(strip_id), 'FAIL', 'missing_source', NULL, NULL FROM frames""",
    "agg_parts": "WITH RECURSIVE " + T.CELLS + f""", pal AS (SELECT rgb, arg_min(role, (rgb // 65536 - c // 65536) ** 2 * 10 + i) AS role FROM (SELECT DISTINCT rgb FROM cells), (VALUES {_PAL}) v(i, role, c) GROUP BY 1),
c AS (SELECT strip_id * 4 + frame AS i, x, y, role FROM cells JOIN pal USING (rgb) WHERE (strip_id * 4 + frame) % 3 <> 0 OR x BETWEEN 2 AND 4),
cl AS (SELECT i, x, y, 'upper' AS part FROM c WHERE y < 4 OR (y = 4 AND i % 5 = 0) UNION ALL SELECT i, x, y, 'lower' FROM c WHERE y >= 4 AND (i % 7 <> 0 OR y < 7) UNION ALL SELECT DISTINCT i, 9, 9, 'lower' FROM c WHERE i % 11 = 0),
n AS (SELECT i, part, x, y, CAST(y * 1000 + x AS BIGINT) AS id FROM cl), r AS (SELECT * FROM n UNION SELECT n.i, n.part, n.x, n.y, r.id FROM r JOIN n ON n.i = r.i AND n.part = r.part AND abs(n.x - r.x) + abs(n.y - r.y) = 1),
k AS (SELECT i, part, x, y, min(id) AS comp FROM r GROUP BY ALL), kk AS (SELECT i, max(n) AS n FROM (SELECT i, part, count(DISTINCT comp) AS n FROM k GROUP BY ALL) GROUP BY 1),
g AS (SELECT DISTINCT i FROM c), q AS (SELECT g.i, i % 13 = 0 AS r1, EXISTS (SELECT 1 FROM cl a JOIN cl b ON a.i = b.i AND a.x = b.x AND a.y = b.y AND a.part < b.part WHERE a.i = g.i) AS r2, i % 11 = 0 AS r3, i % 17 = 0 OR i % 13 = 0 AS r4, EXISTS (SELECT 1 FROM c WHERE c.i = g.i AND NOT EXISTS (SELECT 1 FROM cl WHERE cl.i = c.i AND cl.x = c.x AND cl.y = c.y)) AS r5,
 coalesce((SELECT n > 1 FROM kk WHERE kk.i = g.i), false) AS r6, NOT EXISTS (SELECT 1 FROM cl WHERE cl.i = g.i AND x = 3 AND y = 1 AND part = 'upper') AS r7, i % 17 = 0 OR NOT EXISTS (SELECT 1 FROM cl a JOIN cl b ON a.i = b.i AND a.part = 'lower' AND b.part = 'upper' AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 WHERE a.i = g.i) AS r8,
 EXISTS (SELECT 1 FROM c WHERE c.i = g.i AND ((role = 'cloth' AND NOT EXISTS (SELECT 1 FROM cl l WHERE l.i = c.i AND l.x = c.x AND l.y = c.y AND part = 'lower')) <> EXISTS (SELECT 1 FROM cl u WHERE u.i = c.i AND u.x = c.x AND u.y = c.y AND part = 'upper'))) AS r9 FROM g)
SELECT i AS strip_id, CASE WHEN r1 THEN '{P.RULES[0]}' WHEN r2 THEN '{P.RULES[1]}' WHEN r3 THEN '{P.RULES[2]}' WHEN r4 THEN '{P.RULES[3]}' WHEN r5 THEN '{P.RULES[4]}' WHEN r6 THEN '{P.RULES[5]}' WHEN r7 THEN '{P.RULES[6]}' WHEN r8 THEN '{P.RULES[7]}' WHEN r9 THEN '{P.RULES[8]}' END AS reason FROM q""",
}
QUERIES = {n: globals()[n] for n in SQL}
