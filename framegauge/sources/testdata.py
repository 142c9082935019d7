"""Frame, pixel and ledger tables made from the driver's tables, and the same as SQL.

A strip is four consecutive embedding rows; a frame is one row's 64 components on an 8 x 8 grid, occupied where the
component is positive, with a colour of sixteen red levels by its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

W = H = 8
CLASSES = ("idle", "blob_idle", "walk", "swing", "airborne", "emissive")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cells(strip_id, frame, x, y, rgb); absence of a row is an empty cell."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v")).filter("v > 0")
    red = F.least(F.lit(255), F.floor(F.col("v") * 1024).cast("int"))
    red = (red - red % 16).cast("int")
    return e.select(
        F.expr("vec_id div 4").alias("strip_id"), F.expr("cast(vec_id % 4 as int)").alias("frame"),
        (F.col("pos") % W).cast("int").alias("x"), F.expr(f"cast(pos div {W} as int)").alias("y"), (red * 65536 + 64 * 256 + 32).cast("int").alias("rgb"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frames(strip_id, frame, w, h, motion_class), so that empty frames exist."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    kind = F.element_at(F.array(*(F.lit(c) for c in CLASSES)), (F.col("label") % 6 + 1).cast("int"))
    heads = e.filter("vec_id % 4 = 0").select(F.expr("vec_id div 4").alias("strip_id"), kind.alias("motion_class"))
    rows = e.select(F.expr("vec_id div 4").alias("strip_id"), F.expr("cast(vec_id % 4 as int)").alias("frame"), F.lit(W).alias("w"), F.lit(H).alias("h"))
    return rows.join(heads, "strip_id")


def strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """strips(strip_id, motion_class, n): a row for each strip."""
    return frames(spark, sf_dir).groupBy("strip_id", "motion_class").agg(F.count("*").cast("int").alias("n"))


def classes(spark: SparkSession) -> DataFrame:
    """Motion classes: whether grounded, whether looping, facing, frame size, origin and least alignment sharpness."""
    # Fixed values.
    rows = [
        ("idle", True, True, "free", 16, 24, 0, 0, None), ("blob_idle", True, True, "free", 16, 24, 0, 0, None), ("walk", True, True, "fixed", 16, 24, 0, 0, None),
        ("swing", True, False, "fixed", 24, 24, 1, 0, None), ("airborne", False, True, "free", 16, 24, 0, 0, 0.015), ("emissive", True, True, "free", 16, 24, 0, 0, None),
    ]
    return spark.createDataFrame(rows, "motion_class string, grounded boolean, loops boolean, facing string, frame_w int, frame_h int, origin_x int, origin_y int, min_sharpness double")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pixels(image_id, x, y, r, g, b, a): each frame four times as large, empty cells in the key colour, one border."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("pos", "v"))
    red = F.least(F.lit(255), F.floor(F.abs("v") * 1024).cast("int"))
    e = e.select("image_id", (F.col("pos") % W).cast("int").alias("cx"), F.expr(f"cast(pos div {W} as int)").alias("cy"), (F.col("v") > 0).alias("fg"), (red - red % 16).cast("int").alias("red"))
    e = e.select("*", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k"))
    on = lambda yes, no: F.when(F.col("fg"), yes).otherwise(no).cast("int")
    return e.select(
        "image_id", (F.col("cx") * 4 + F.col("k") % 4 + 4).cast("int").alias("x"), (F.col("cy") * 4 + F.expr("k div 4") + 4).cast("int").alias("y"),
        on(F.col("red"), F.lit(255) - F.col("red") % 64).alias("r"), on(F.lit(64), F.lit(0)).alias("g"), on(F.lit(32), F.lit(255)).alias("b"), F.lit(255).alias("a"),
    )


#: CTEs of the same tables for DuckDB.
CLASS_SQL = "(VALUES ('idle',true,true,NULL::DOUBLE),('blob_idle',true,true,NULL),('walk',true,true,NULL),('swing',true,false,NULL),('airborne',false,true,0.015),('emissive',true,true,NULL)) AS c(motion_class,grounded,loops,min_sharpness)"
CELLS = f"""e AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
cells AS (SELECT vec_id // 4 AS strip_id, CAST(vec_id % 4 AS INT) AS frame, CAST(pos % {W} AS INT) AS x, CAST(pos // {W} AS INT) AS y,
  CAST((least(255, CAST(floor(v * 1024) AS INT)) // 16 * 16) * 65536 + 64 * 256 + 32 AS INT) AS rgb FROM e WHERE v > 0),
heads AS (SELECT vec_id // 4 AS strip_id, ['idle','blob_idle','walk','swing','airborne','emissive'][label % 6 + 1] AS motion_class FROM embeddings WHERE vec_id % 4 = 0),
frames AS (SELECT vec_id // 4 AS strip_id, CAST(vec_id % 4 AS INT) AS frame, {W} AS w, {H} AS h, motion_class FROM embeddings JOIN heads ON vec_id // 4 = heads.strip_id),
strips AS (SELECT strip_id, motion_class, CAST(count(*) AS INT) AS n FROM frames GROUP BY ALL),
masks AS (SELECT strip_id, frame, y, CAST(sum(1 << x) AS BIGINT) AS m FROM cells GROUP BY ALL),
dense AS (SELECT f.strip_id, f.frame, CAST(yy.y AS INT) AS y, coalesce(m, 0) AS m FROM frames f CROSS JOIN range({H}) yy(y) LEFT JOIN masks k ON f.strip_id = k.strip_id AND f.frame = k.frame AND yy.y = k.y),
base AS (SELECT f.strip_id, f.frame, max(c.y) AS baseline FROM frames f LEFT JOIN cells c USING (strip_id, frame) GROUP BY ALL),
classes AS (SELECT * FROM {CLASS_SQL}),
anchors AS (SELECT s.strip_id, s.motion_class, s.n, loops, grounded, min_sharpness, CASE WHEN grounded THEN coalesce(b.baseline, {H}) ELSE {H} END AS anchor
  FROM strips s JOIN classes USING (motion_class) JOIN base b ON s.strip_id = b.strip_id AND b.frame = 0)"""
PIXELS = f"""pe AS (SELECT vec_id AS image_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
pc AS (SELECT image_id, pos % {W} AS cx, pos // {W} AS cy, v > 0 AS fg, least(255, CAST(floor(abs(v) * 1024) AS INT)) // 16 * 16 AS red FROM pe),
pixels AS (SELECT image_id, CAST(cx * 4 + k % 4 + 4 AS INT) AS x, CAST(cy * 4 + k // 4 + 4 AS INT) AS y, CASE WHEN fg THEN red ELSE 255 - red % 64 END AS r,
  CASE WHEN fg THEN 64 ELSE 0 END AS g, CASE WHEN fg THEN 32 ELSE 255 END AS b, 255 AS a FROM pc CROSS JOIN range(16) t(k))"""
