"""Operators on pixel and cell tables: column arithmetic and aggregation; the components of a tile and the grid of a profile are found by NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.scalars import delta_e, keyed, luma, rgb_distance
from ..sources.shared import cut

#: Side of the tiles in which components are found first; pixels that a task sorts; teeth of grids that are compared at once.
TILE, PIXELS_A_TASK, TEETH_AT_ONCE = 32, 1 << 20, 1 << 20


def key_mask(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("keyed", keyed("r", "g", "b", "a"))


def border_ratio(pixels: DataFrame, width: int = 2, least: float = 0.95) -> DataFrame:
    """Keyed and all pixels of each image's border, less its bottom left one, and whether the share is enough."""
    size = pixels.groupBy("image_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    # pixels made by explode are planned at the size of what they came from: without a hint they are broadcast
    rows = key_mask(pixels).join(size.hint("shuffle_hash"), "image_id")
    edge = (F.col("x") < F.col("x0") + width) | (F.col("x") > F.col("x1") - width) | (F.col("y") < F.col("y0") + width) | (F.col("y") > F.col("y1") - width)
    stamp = (F.col("x") == F.col("x0")) & (F.col("y") == F.col("y1"))
    out = rows.filter(edge & ~stamp).groupBy("image_id").agg(F.count_if("keyed").alias("keyed"), F.count("*").alias("pixels"))
    return out.withColumn("ok", F.col("keyed") >= F.col("pixels") * least)


def bounding_box(pixels: DataFrame) -> DataFrame:
    """Box of what is not keyed, and the sides at which it touches the canvas."""
    rows = key_mask(pixels).groupBy("image_id").agg(
        *(f(F.when(~F.col("keyed"), F.col(c))).alias(f"{n}_{c}") for c in ("x", "y") for f, n in ((F.min, "min"), (F.max, "max"))),
        *(f(c).alias(f"edge_{n}_{c}") for c in ("x", "y") for f, n in ((F.min, "min"), (F.max, "max"))),
    )
    sides = [("min_y", "top"), ("max_y", "bottom"), ("min_x", "left"), ("max_x", "right")]
    touch = F.concat_ws(",", *(F.when(F.col(c) == F.col(f"edge_{c}"), F.lit(n)) for c, n in sides))
    return rows.select("image_id", "min_x", "max_x", "min_y", "max_y", touch.alias("clipped"))


def edge_profile(pixels: DataFrame) -> DataFrame:
    """Energy of each pixel column: sum of channel differences to the pixel before, where both are foreground.

    Pixels are shuffled once, by image, to as many tasks as their count calls for: few bytes a pixel when compressed, they
    would else be merged at run time into tasks that sort far more than they read.
    """
    tasks = max(int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pixels.count() // PIXELS_A_TASK))
    w = Window.partitionBy("image_id", "y").orderBy("x")
    rows = key_mask(pixels).select("image_id", "x", "y", "r", "g", "b", "keyed").repartition(tasks, "image_id")
    before = [F.lag(c).over(w) for c in ("r", "g", "b")]
    energy = sum((F.abs(F.col(c) - p) for c, p in zip(("r", "g", "b"), before, strict=True)), F.lit(0))
    near = ~F.col("keyed") & ~F.lag("keyed").over(w) & (F.col("x") - F.lag("x").over(w) == 1)
    return rows.withColumn("e", F.when(near, energy).otherwise(0)).groupBy("image_id", "x").agg(F.sum("e").alias("energy"))


def sample_cells(pixels: DataFrame, pitch: int, phase: int, margin: float = 0.3) -> DataFrame:
    """Colour of each cell from the pixels around its middle: none under half foreground, else each channel's lower median."""
    cell = lambda c: F.floor((F.col(c) - phase) / pitch).cast("int")
    off = lambda c: F.abs((F.col(c) - phase + 0.5) / pitch - F.floor((F.col(c) - phase) / pitch) - 0.5)
    rows = key_mask(pixels).withColumns({"cx": cell("x"), "cy": cell("y")}).filter((off("x") <= margin) & (off("y") <= margin))
    mid = lambda c: F.expr(f"percentile_disc(0.5) within group (order by case when not keyed then {c} end)").cast("int")
    out = rows.groupBy("image_id", "cx", "cy").agg(F.count("*").alias("n"), F.count_if(~F.col("keyed")).alias("fg"), mid("r").alias("r"), mid("g").alias("g"), mid("b").alias("b"))
    return out.filter(F.col("fg") * 2 >= F.col("n")).select("image_id", "cx", "cy", "r", "g", "b")


def slice_frames(cells: DataFrame, frame_w: int, gutter: int = 0, margin: int = 0) -> DataFrame:
    """Frame number and inner x of cells of a sheet; cells in margins and gutters go."""
    stride = frame_w + gutter
    inner = cells.filter(F.col("x") >= margin).withColumn("x", F.col("x") - margin)
    return inner.withColumns({"frame": F.expr(f"cast(x div {stride} as int)"), "x": (F.col("x") % stride).cast("int")}).filter(F.col("x") < frame_w)


def canonicalise(cells: DataFrame, w: int, h: int, source_h: int) -> DataFrame:
    """Cells on a w x h canvas: padded on top if short, else with the lowest occupied row at the bottom, within bounds."""
    low = F.max("y").over(Window.partitionBy("strip_id", "frame"))
    top = F.least(F.greatest(low - (h - 1), F.lit(0)), F.lit(source_h - h))
    shift = F.lit(h - source_h) if source_h <= h else -top
    return cells.withColumn("_d", shift).withColumn("y", (F.col("y") + F.col("_d")).cast("int")).drop("_d").filter((F.col("x") < w) & (F.col("y") >= 0) & (F.col("y") < h))


def orientations(cells: DataFrame, w: int, h: int) -> DataFrame:
    """All eight lattice orientations of each cell of a w x h footprint, with `turn` 0 to 3 and `mirror`."""
    rows = cells.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("mirror")).select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("turn"))
    x = F.when(F.col("mirror"), w - 1 - F.col("x")).otherwise(F.col("x"))
    y = F.col("y")
    tx = F.when(F.col("turn") == 0, x).when(F.col("turn") == 1, h - 1 - y).when(F.col("turn") == 2, w - 1 - x).otherwise(y)
    ty = F.when(F.col("turn") == 0, y).when(F.col("turn") == 1, x).when(F.col("turn") == 2, h - 1 - y).otherwise(w - 1 - x)
    return rows.withColumns({"tx": tx.cast("int"), "ty": ty.cast("int")})


def mutate(cells: DataFrame, w: int, h: int, frame: int = 2, dx: int = 3, dy: int = 3) -> DataFrame:
    """Every cell under each mutation of one frame: recolour, hop, mirror, slide and hold (the pose before)."""
    kinds = F.array(*(F.lit(k) for k in ("recolour", "hop", "mirror", "slide", "hold")))
    rows = cells.select("*", F.explode(kinds).alias("mutation"))
    hit, is_ = F.col("frame") == frame, lambda k: F.col("mutation") == k
    r, g, b = F.shiftright("rgb", 16), F.shiftright("rgb", 8).bitwiseAND(255), F.col("rgb").bitwiseAND(255)
    hot = F.least(r + 110, F.lit(255)) * 65536 + F.floor(g / 3).cast("int") * 256 + F.floor(b / 3).cast("int")
    held = rows.filter(is_("hold") & (F.col("frame") == frame - 1)).withColumn("frame", F.lit(frame))
    rows = rows.filter(~(is_("hold") & hit)).withColumns({
        "rgb": F.when(hit & is_("recolour"), hot).otherwise(F.col("rgb")).cast("int"),
        "y": F.when(hit & is_("hop"), F.col("y") - dy).otherwise(F.col("y")).cast("int"),
        "x": F.when(hit & is_("mirror"), w - 1 - F.col("x")).when(hit & is_("slide"), F.col("x") + dx).otherwise(F.col("x")).cast("int"),
    })
    return rows.unionByName(held).filter((F.col("y") >= 0) & (F.col("x") < w))


def runs(cells: DataFrame, w: int) -> DataFrame:
    """Runs of occupied and empty columns of each frame: first and last column and kind."""
    taken = cells.select("strip_id", "frame", "x").distinct().withColumn("full", F.lit(True))
    dense = taken.select("strip_id", "frame").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(w - 1))).alias("x"))
    rows = dense.join(taken, ["strip_id", "frame", "x"], "left").withColumn("full", F.coalesce("full", F.lit(False)))
    island = F.col("x") - F.row_number().over(Window.partitionBy("strip_id", "frame", "full").orderBy("x"))
    return rows.withColumn("_i", island).groupBy("strip_id", "frame", "full", "_i").agg(F.min("x").alias("first"), F.max("x").alias("last")).drop("_i")


def column_loads(cells: DataFrame, frames: DataFrame) -> DataFrame:
    """Occupied cells of every column of every frame, zeros too."""
    dense = frames.select("strip_id", "frame", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x"))
    return dense.join(cells.groupBy("strip_id", "frame", "x").agg(F.count("*").alias("load")), ["strip_id", "frame", "x"], "left").withColumn("load", F.coalesce("load", F.lit(0)))


def neighbour_masks(cells: DataFrame) -> DataFrame:
    """N = 1, E = 2, S = 4, W = 8 for each occupied cell's occupied neighbours, and the tile variant (x + 3y) % 3."""
    here = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(bit).alias("bit")) for dx, dy, bit in ((0, 1, 1), (-1, 0, 2), (0, -1, 4), (1, 0, 8)))))
    # each cell tells its neighbours that it is there
    told = cells.select("strip_id", "frame", "x", "y", here.alias("n")).select("strip_id", "frame", (F.col("x") + F.col("n.dx")).alias("x"), (F.col("y") + F.col("n.dy")).alias("y"), "n.bit")
    masks = told.groupBy("strip_id", "frame", "x", "y").agg(F.sum("bit").alias("mask"))
    rows = cells.join(masks, ["strip_id", "frame", "x", "y"], "left")
    return rows.select("strip_id", "frame", "x", "y", F.coalesce("mask", F.lit(0)).alias("mask"), ((F.col("x") + F.col("y") * 3) % 3).cast("int").alias("variant"))


def components(cells: DataFrame) -> DataFrame:
    """(strip_id, frame, x, y, component) of 4-connected cells: the smallest y * 2^20 + x that can be reached.

    Frames are cut into tiles of TILE x TILE cells, each labelled by itself in one pass. Labels that touch across the
    seams of tiles are nodes of a graph, which take their neighbours' minimum, and their minimum's, until nothing changes;
    frames of one tile have no seams.
    """
    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of tiles with cs: for each cell of ps the first cell (by row, then column) of its component inside the tile."""
        for batch in batches:
            ps = batch.column("ps")
            sizes, area = ps.value_lengths().to_numpy(zero_copy_only=False), TILE * TILE
            # all tiles of the batch at once; neighbours are found by their numbers
            ids, back = np.unique(np.repeat(np.arange(len(sizes), dtype=np.int64), sizes) * area + ps.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
            ends = []
            for step, inside in ((1, ids % TILE < TILE - 1), (TILE, ids % area < area - TILE)):
                i = np.flatnonzero(inside)
                j = np.minimum(np.searchsorted(ids, ids[i] + step), len(ids) - 1)
                there = ids[j] == ids[i] + step
                ends.append(np.stack([i[there], j[there]]))
            a, b = np.concatenate(ends, axis=1)
            label = np.arange(len(ids))
            while True:
                p, q = label[a], label[b]
                if (p == q).all():
                    break
                np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
                while (label != (up := label[label])).any():
                    label = up
            cs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids[label[back.ravel()]] % area, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), cs], names=[*batch.schema.names[:5], "cs"])

    types, keys = dict(cells.dtypes), ["strip_id", "frame"]
    tile = lambda c: F.floor(F.col(c) / TILE).cast("int")
    spots = cells.filter("x is not null and y is not null").select(*keys, tile("x").alias("tx"), tile("y").alias("ty"), F.expr(f"cast(pmod(y, {TILE}) * {TILE} + pmod(x, {TILE}) as int)").alias("p"))
    tiles = spots.filter("strip_id is not null and frame is not null").groupBy(*keys, "tx", "ty").agg(F.collect_list("p").alias("ps"))
    known = tiles.mapInArrow(labelled, f"strip_id {types['strip_id']}, frame {types['frame']}, tx int, ty int, ps array<int>, cs array<int>")
    rows = known.select(*keys, "tx", "ty", F.explode(F.arrays_zip("ps", "cs")).alias("c"))
    spot = lambda c: (F.col("tx") * TILE + F.col(c) % TILE, F.col("ty") * TILE + F.expr(f"{c} div {TILE}"))
    (x, y), (low_x, low_y) = spot("c.ps"), spot("c.cs")
    rows = cut(rows.select(*keys, x.cast(types["x"]).alias("x"), y.cast(types["y"]).alias("y"), (low_y * F.lit(1 << 20) + low_x).cast("long").alias("component")), "components")
    touching = None
    for over, along in (("x", "y"), ("y", "x")):
        last = rows.filter(F.expr(f"pmod({over}, {TILE}) = {TILE - 1}")).select(*keys, (F.col(over) + 1).alias(over), along, F.col("component").alias("a"))
        first = rows.filter(F.expr(f"pmod({over}, {TILE}) = 0")).select(*keys, over, along, F.col("component").alias("b"))
        both = last.join(first, [*keys, over, along]).select(*keys, "a", "b").distinct()
        touching = both if touching is None else touching.union(both)
    edges = cut(touching.union(touching.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))), "seams")
    if edges.limit(1).count() == 0:
        return rows
    nodes = edges.select(*keys, F.col("a").alias("node"), F.col("a").alias("low")).distinct()
    while True:
        told = edges.join(nodes.withColumnsRenamed({"node": "b", "low": "other"}), [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("other").alias("other"))
        new = cut(nodes.join(told, [*keys, "node"]).select(*keys, "node", "low", F.least("low", "other").alias("near")), "near")
        # a label's own label is as near as the label
        new = new.join(new.select(*keys, F.col("node").alias("near"), F.col("near").alias("far")), [*keys, "near"]).select(*keys, "node", F.col("far").alias("low"), (F.col("far") < F.col("low")).alias("changed"))
        new = cut(new, "labels")
        nodes = new.drop("changed")
        if new.filter("changed").limit(1).count() == 0:
            break
    out = rows.join(nodes.withColumnRenamed("node", "component"), [*keys, "component"], "left")
    return out.select(*keys, "x", "y", F.coalesce("low", "component").alias("component"))


def nearest_entry(colours: DataFrame, palette: DataFrame) -> DataFrame:
    """(rgb, ord, entry, role, distance): the palette entry of least squared distance for each distinct colour, ties by
    palette order; palette has ord, rgb and role. The role proposes an assignment, it is none."""
    pairs = colours.select("rgb").distinct().crossJoin(F.broadcast(palette.select("ord", "role", F.col("rgb").alias("entry"))))
    best = pairs.groupBy("rgb").agg(F.min(F.struct(rgb_distance("rgb", "entry").alias("d"), "ord", "entry", "role")).alias("m"))
    return best.select("rgb", "m.ord", "m.entry", "m.role", F.col("m.d").alias("distance"))


def nearest_in_role(colours: DataFrame, palette: DataFrame) -> DataFrame:
    """(rgb, role, entry): the nearest entry of a role for each distinct colour and role, null for a role that the palette
    lacks. Ties go to the lower luminance, then to palette order, so that quantising twice changes nothing."""
    entries = palette.select(F.col("role").alias("_role"), "ord", F.col("rgb").alias("entry"))
    pairs = colours.select("rgb", "role").distinct().join(F.broadcast(entries), F.col("role") == F.col("_role"), "left")
    best = pairs.groupBy("rgb", "role").agg(F.min(F.when(F.col("entry").isNotNull(), F.struct(rgb_distance("rgb", "entry").alias("d"), luma("entry").alias("l"), "ord", "entry"))).alias("m"))
    return best.select("rgb", "role", "m.entry")


def min_delta(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys and least: the least CIE76 difference between two colours of a key; keys of one colour have no row."""
    colours = cells.select(*keys, "rgb").distinct()
    both = colours.join(colours.withColumnRenamed("rgb", "other"), keys).filter("rgb < other")
    return both.groupBy(*keys).agg(F.min(delta_e("rgb", "other")).alias("least"))


def quantise(cells: DataFrame, palette: DataFrame) -> DataFrame:
    return cells.join(nearest_entry(cells, palette), "rgb").drop("rgb", "ord", "distance", "role").withColumnRenamed("entry", "rgb")


def quantise_in_roles(cells: DataFrame, palette: DataFrame) -> DataFrame:
    """cells(..., rgb, role) with rgb the nearest colour of the cell's role, and reason: missing_role or unknown_role, whose
    cells have no colour. palette(ord, role, rgb) is a parameter's size."""
    near = nearest_in_role(cells.filter("role is not null"), palette).withColumnsRenamed({"rgb": "_rgb", "role": "_role"})
    rows = cells.join(near, (F.col("rgb") == F.col("_rgb")) & (F.col("role") == F.col("_role")), "left")
    reason = F.when(F.col("role").isNull(), "missing_role").when(F.col("entry").isNull(), "unknown_role")
    return rows.select(*(c for c in cells.columns if c != "rgb"), F.col("entry").alias("rgb"), reason.alias("reason"))


def palettes(colours: DataFrame, merge: int = 32, most: int = 16) -> DataFrame:
    """colours(strip_id, rgb, n, at). One row a strip: colours (how many), clusters, and palette, an array of rgb and cells.

    Leader clustering: frequent colours lead (ties by least `at`, their first place), near ones join the first leader
    within the distance, and the leaders with most cells make the palette, ties by the lower colour.
    """
    lists = colours.groupBy("strip_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "at", "rgb"))).alias("all"))
    start = F.array().cast("array<struct<leader:int,n:bigint>>")

    def add(state: Column, c: Column) -> Column:
        near = F.filter(state, lambda s: rgb_distance(s["leader"], c["rgb"]) <= merge * merge)
        lead = F.get(near, F.lit(0))["leader"]
        joined = F.transform(state, lambda s: F.struct(s["leader"].alias("leader"), F.when(s["leader"] == lead, s["n"] - c["minus"]).otherwise(s["n"]).alias("n")))
        return F.when(F.size(near) > 0, joined).otherwise(F.concat(state, F.array(F.struct(c["rgb"].alias("leader"), (-c["minus"]).alias("n")))))

    ranked = F.array_sort(F.transform(F.aggregate("all", start, add), lambda s: F.struct((-s["n"]).alias("minus"), s["leader"].alias("rgb"))))
    lists = lists.select("strip_id", F.size("all").alias("colours"), ranked.alias("ranked"))
    return lists.select("strip_id", "colours", F.size("ranked").alias("clusters"), F.expr(f"transform(slice(ranked, 1, {most}), c -> struct(c.rgb as rgb, -c.minus as cells))").alias("palette"))


def shared_palette(cells: DataFrame, merge: int = 32, most: int = 16) -> DataFrame:
    """The palette of each strip's cells (palettes) as rows: strip_id, ord, rgb and cells."""
    colours = cells.groupBy("strip_id", "rgb").agg(F.count("*").alias("n"), F.min(F.struct("frame", "y", "x")).alias("at"))
    return palettes(colours, merge, most).select("strip_id", F.posexplode("palette").alias("ord", "c")).select("strip_id", "ord", "c.rgb", "c.cells")


def cell_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of either side that the other lacks or has in another colour: keys, from_rgb and to_rgb."""
    both = a.select(*keys, F.col("rgb").alias("from_rgb")).join(b.select(*keys, F.col("rgb").alias("to_rgb")), keys, "full_outer")
    return both.filter(~F.col("from_rgb").eqNullSafe(F.col("to_rgb")))


def replay(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """base with a delta's cells set to to_rgb; null there empties a cell."""
    rows = base.join(delta.select(*keys, "to_rgb", F.lit(True).alias("_d")), keys, "full_outer")
    return rows.withColumn("rgb", F.when(F.col("_d"), F.col("to_rgb")).otherwise(F.col("rgb"))).filter("rgb is not null").select(*keys, "rgb")


def pitch_search(profile: DataFrame, least: float, most: float, step: float = 0.05, phase_step: float = 0.5, epsilon: float = 0.15) -> DataFrame:
    """(image_id, pitch, phase, score): the grid whose teeth best meet the columns of an edge profile.

    profile(image_id, x, energy) has a row for each column from the first to the last that counts. A tooth takes the
    strongest of the three columns around it (the first on ties) and hits if that is over epsilon of the peak; the
    score is the share of energy in distinct columns taken, times the share of hits. Ties go to the smaller pitch, then
    phase; images without energy get score -1. All grids are tried at once on the images of a batch with equal ends.
    """
    none = F.lit(0).cast("long")
    images = profile.groupBy("image_id").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("energy").alias("total"), F.max("energy").alias("peak"), F.array_sort(F.collect_list(F.struct("x", "energy"))).alias("at"))
    sparse = F.transform(F.sequence("lo", "hi"), lambda x: F.coalesce(F.try_element_at(F.map_from_entries("at"), x), none))
    e = F.when(F.size("at") == F.col("hi") - F.col("lo") + 1, F.transform("at", lambda c: F.coalesce(c["energy"], none))).otherwise(sparse)
    images = images.select("image_id", "lo", "hi", "total", "peak", F.when(F.col("total") > 0, e).alias("e"))

    pitches = least + np.arange(round((most - least) / step) + 1) * step
    phases = np.ceil(pitches / phase_step).astype(np.int64)
    counted = lambda n: np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    pitch, phase = np.repeat(pitches, phases), counted(phases) * phase_step

    def teeth(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The grids that have teeth between lo and hi, where in columns theirs begin, how many, and the teeth's columns from lo."""
        first = np.ceil((lo - phase) / pitch)
        n = np.maximum(np.floor((hi - phase) / pitch) - first + 1, 0).astype(np.int64)
        of = np.repeat(np.arange(len(pitch)), n)
        place = phase[of] + (np.repeat(first, n) + counted(n)) * pitch[of]
        inside = (place > lo + 0.5) & (place < hi - 0.5)
        return *np.unique(of[inside], return_index=True, return_counts=True), (np.rint(place[inside]) - lo).astype(np.int64)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, hi, total, peak = (batch.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("lo", "hi", "total", "peak"))
            es = batch.column("e")
            flat, rows = es.flatten().to_numpy(zero_copy_only=False), np.flatnonzero(es.is_valid().to_numpy(zero_copy_only=False))
            begins = np.zeros(len(lo), np.int64)
            begins[rows] = np.cumsum(hi[rows] - lo[rows] + 1, dtype=np.int64) - (hi[rows] - lo[rows] + 1)
            best = np.tile(np.array([least, 0.0, -1.0]), (len(lo), 1))
            ends, group = np.unique(np.stack([lo[rows], hi[rows]]), axis=1, return_inverse=True)
            alike = np.split(rows[np.argsort(group.ravel(), kind="stable")], np.cumsum(np.bincount(group.ravel()))[:-1])
            for (low, high), members in zip(ends.T.tolist(), alike, strict=True):
                grids, starts, counts, columns = teeth(low, high)
                some = max(1, TEETH_AT_ONCE // max(1, len(columns)))
                for i in (members[k : k + some] for k in range(0, len(members) if len(grids) else 0, some)):
                    x = np.arange(high - low + 1)
                    energy = flat[begins[i][:, None] + x]
                    sides = np.pad(energy, ((0, 0), (1, 1)))
                    strongest = np.maximum(np.maximum(sides[:, :-2], energy), sides[:, 2:])
                    taken = (x + np.where(sides[:, :-2] == strongest, -1, np.where(energy == strongest, 0, 1)))[:, columns]
                    strongest = strongest[:, columns]
                    # teeth that take the same column are neighbours: it counts for the first of them
                    fresh = np.ones(taken.shape, bool)
                    fresh[:, 1:] = taken[:, 1:] != taken[:, :-1]
                    fresh[:, starts] = True
                    covered = np.add.reduceat(strongest * fresh, starts, axis=1)
                    hits = np.add.reduceat((strongest > (peak[i] * epsilon)[:, None]).astype(np.int64), starts, axis=1)
                    score = covered / total[i][:, None] * (hits / counts)
                    won = score.argmax(axis=1)
                    best[i] = np.stack([pitch[grids[won]], phase[grids[won]], score[np.arange(len(i)), won]], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), *(pa.array(c) for c in best.T)], names=["image_id", "pitch", "phase", "score"])

    out = StructType([images.schema["image_id"], *(StructField(c, DoubleType()) for c in ("pitch", "phase", "score"))])
    return images.mapInArrow(fitted, out)
