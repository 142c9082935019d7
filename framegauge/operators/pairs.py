"""Frame pairs compared under bounded shifts, on bit masks of frame rows.

A frame row is cut into blocks of 32 cells. A block's word has its cells and MARGIN more on both sides, so that a shift
of a whole row is a shift of each word, however wide the frame is. All frames of a strip stand in one row, and a pair is
scored at every shift in place: one shuffle by strip, whatever the number of shifts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK, MARGIN = 32, 15


def masks(cells: DataFrame, frames: DataFrame) -> DataFrame:
    """(strip_id, words): for each frame of a strip its w, h and the words of its rows, one after the other.

    A row of a frame has ceil(w / 32) + 1 words; bit 15 of word k is the cell at x = 32 k.
    """
    x = F.col("x")
    block = F.explode(F.sequence(F.greatest(F.floor((x - MARGIN + 1) / BLOCK), F.lit(0)), F.floor((x + MARGIN) / BLOCK))).alias("block")
    bits = cells.select("strip_id", "frame", "y", "x", block).select("strip_id", "frame", F.col("y").cast("int").alias("y"), F.col("block").cast("int").alias("block"), _left(F.lit(1).cast("long"), (x - F.col("block") * BLOCK + MARGIN).cast("int")).alias("m"), F.lit(None).cast("int").alias("w"), F.lit(None).cast("int").alias("h"))
    empty = frames.select("strip_id", "frame", F.lit(0).alias("y"), F.lit(0).alias("block"), F.lit(0).cast("long").alias("m"), F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h"))
    # by number, since a strip's words are few bytes but its pairs much work: such partitions are not merged at run time
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = bits.union(empty).repartition(tasks, "strip_id").groupBy("strip_id", "frame", "y", "block").agg(F.bit_or("m").alias("m"), F.max("w").alias("w"), F.max("h").alias("h"))
    lists = rows.groupBy("strip_id", "frame").agg(F.max("w").alias("w"), F.max("h").alias("h"), F.collect_list(F.struct("y", "block", "m")).alias("l")).filter("w is not null")
    stride = F.ceil(F.col("w") / BLOCK).cast("int") + 1
    known = F.map_from_entries(F.transform("l", lambda e: F.struct(e["y"] * F.col("stride") + e["block"], e["m"])))
    lists = lists.withColumn("stride", stride).withColumn("k", known)
    words = F.transform(F.sequence(F.lit(0), F.col("h") * F.col("stride") - 1), lambda i: F.coalesce(F.try_element_at(F.col("k"), i), F.lit(0).cast("long")))
    each = lists.select("strip_id", "frame", F.struct("w", "h", "stride", words.alias("words")).alias("f"))
    return each.groupBy("strip_id").agg(F.map_from_entries(F.collect_list(F.struct("frame", "f"))).alias("words"))


def _left(x: Column, n: Column) -> Column:
    return F.call_function("shiftleft", x, n)


def _right(x: Column, n: Column) -> Column:
    return F.call_function("shiftright", x, n)


def baselines(cells: DataFrame, frames: DataFrame) -> DataFrame:
    """(strip_id, frame, baseline): the lowest occupied row, null for an empty frame."""
    low = cells.groupBy("strip_id", "frame").agg(F.max("y").alias("baseline"))
    return frames.select("strip_id", "frame").join(low, ["strip_id", "frame"], "left")


def anchors(cells: DataFrame, frames: DataFrame, classes: DataFrame) -> DataFrame:
    """One row for each strip with its class and the row at and below which nothing counts (full height if ungrounded)."""
    first = baselines(cells, frames).filter("frame = 0").select("strip_id", "baseline")
    strips = frames.groupBy("strip_id", "motion_class").agg(F.count("*").cast("int").alias("n"), F.max("h").alias("h"))
    rows = strips.join(first, "strip_id").join(F.broadcast(classes), "motion_class")
    anchor = F.when(F.col("grounded"), F.coalesce("baseline", "h")).otherwise(F.col("h"))
    return rows.select("strip_id", "motion_class", "n", "loops", "grounded", "min_sharpness", anchor.alias("anchor"))


def adjacent(strips: DataFrame, wrap: str | Column = "loops") -> DataFrame:
    """Pairs (a, b) of neighbours in each strip; the pair (n - 1, 0) too where wrap holds."""
    wrap = F.col(wrap) if isinstance(wrap, str) else wrap
    rows = strips.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("a"))
    return rows.withColumn("b", ((F.col("a") + 1) % F.col("n")).cast("int")).filter((F.col("b") > 0) | (wrap & (F.col("n") > 1)))


def all_pairs(strips: DataFrame, both_ways: bool = False) -> DataFrame:
    """Pairs a < b inside each strip, or all ordered pairs."""
    rows = strips.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("a"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("b"))
    return rows.filter("a <> b" if both_ways else "a < b")


def shift_scores(pairs: DataFrame, rows: DataFrame, span_x: int, span_y: int = 0) -> DataFrame:
    """strip_id, a, b, anchor and scores: frac, dy, dx, changed and union of each pair at each shift (dx, dy) of b, best first.

    pairs carries the anchor: rows of a at and below it do not count, nor do those that b has not. What is shifted in from outside a frame is empty,
    and what falls outside of it doesn't count; frac is changed / union, 0 where nothing is occupied. Ties go to the
    first in the order of dy, then dx. rows are those of masks().
    """
    if span_x > MARGIN:
        raise ValueError(f"shifts of more than {MARGIN} columns are not covered by the words")
    both = pairs.select("strip_id", "a", "b", "anchor").join(rows, "strip_id").filter("map_contains_key(words, a) and map_contains_key(words, b)")
    both = both.select("strip_id", "a", "b", "anchor", F.element_at("words", F.col("a")).alias("p"), F.element_at("words", F.col("b")).alias("q"))
    words = both.select("strip_id", "a", "b", "anchor", F.explode_outer(_places(span_y)).alias("w")).select("strip_id", "a", "b", "anchor", "w.*")
    # as SQL text: a column object for each of some thousand terms takes the driver longer than the search itself
    across, steps = 2 * span_x + 1, [(dy, dx) for dy in range(2 * span_y + 1) for dx in range(-span_x, span_x + 1)]
    moved = [f"(shiftright(q{dy}, {dx + MARGIN}) & inside)" for dy, dx in steps]
    # changed cells (times 2^32) and occupied ones of each shift, in one number
    sums = words.groupBy("strip_id", "a", "b", "anchor").agg(F.expr(f"array({', '.join(f'sum(shiftleft(cast(bit_count(m ^ {m}) as bigint), 32) + bit_count(m | {m}))' for m in moved)})").alias("sums"))
    ranked = """transform(sums, (s, i) -> named_struct('frac', if(coalesce(s, 0) & 4294967295 = 0, 0D, shiftright(s, 32) / (s & 4294967295)),
        'dy', cast(i div {across} as int) - {span_y}, 'dx', i % {across} - {span_x}, 'changed', coalesce(shiftright(s, 32), 0L), 'union', coalesce(s & 4294967295, 0L)))"""
    return sums.select("strip_id", "a", "b", "anchor", F.array_sort(F.expr(ranked.format(across=across, span_x=span_x, span_y=span_y))).alias("scores"))


def _places(span_y: int) -> Column:
    """The words of frame p that count: m, its cells, inside, the bits inside the frame, and q0 to q<2 span_y>, the words
    of frame q in the rows from span_y above to span_y below; null if there are none."""
    p, q = F.col("p"), F.col("q")
    across = p["stride"] - 1
    n = F.least(p["h"], q["h"], F.col("anchor")) * across

    def place(i: Column) -> Column:
        y, block = (i / across).cast("int"), i % across
        m = _right(F.get(p["words"], y * p["stride"] + block), F.lit(MARGIN)).bitwiseAND((1 << BLOCK) - 1)
        inside = _left(F.lit(1).cast("long"), F.least(F.lit(BLOCK), p["w"] - block * BLOCK)) - 1
        other = lambda dy: F.when((y + dy >= 0) & (y + dy < q["h"]) & (block < q["stride"]), F.get(q["words"], (y + dy) * q["stride"] + block))
        return F.struct(m.alias("m"), inside.alias("inside"), *(F.coalesce(other(dy), F.lit(0).cast("long")).alias(f"q{dy + span_y}") for dy in range(-span_y, span_y + 1)))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), place))


def best_shift(scores: DataFrame) -> DataFrame:
    """The shift of least fraction for each pair: strip_id, a, b, frac, dy, dx, changed, union, and margin (how much less
    it is than the second least one, null with one shift)."""
    margin = F.get("scores", F.lit(1))["frac"] - F.get("scores", F.lit(0))["frac"]
    return scores.select("strip_id", "a", "b", F.get("scores", F.lit(0)).alias("s"), margin.alias("margin")).select("strip_id", "a", "b", "s.*", "margin")


def sharpness(scores: DataFrame) -> DataFrame:
    """(strip_id, a, b, best, second, margin): the two least fractions of each pair and their difference."""
    two = scores.select("strip_id", "a", "b", F.get("scores", F.lit(0))["frac"].alias("best"), F.get("scores", F.lit(1))["frac"].alias("second"))
    return two.withColumn("margin", F.col("second") - F.col("best"))


def worst_pair(scores: DataFrame) -> DataFrame:
    """(strip_id, min_margin, worst_a): the least margin of a strip's pairs, and the first frame whose pair has it.

    Margins are compared as whole 1e-18ths of the exact ratio, so that equal ones are ties however their fractions round
    (exactly, for unions of up to 30,000 cells).
    """
    best, second = F.get("scores", F.lit(0)), F.get("scores", F.lit(1))
    names = {"c1": best["changed"], "u1": F.greatest(best["union"], F.lit(1)), "c2": second["changed"], "u2": F.greatest(second["union"], F.lit(1))}
    rows = scores.select("strip_id", "a", (second["frac"] - best["frac"]).alias("margin"), *(c.cast("decimal(9,0)").alias(n) for n, c in names.items()))
    exact = F.expr("cast(c2 * u1 - c1 * u2 as decimal(19,0)) * 1000000000000000000BD div (u1 * u2)")
    worst = rows.groupBy("strip_id").agg(F.min("margin").alias("min_margin"), F.min(F.struct(exact.alias("m"), "a")).alias("w"))
    return worst.select("strip_id", "min_margin", F.col("w.a").alias("worst_a"))


def antisymmetric(in_dx: str, in_dy: str, out_dx: str, out_dy: str, tolerance: int = 1) -> Column:
    """Whether two shifts are each other's negation within a tolerance in the larger component."""
    return F.greatest(F.abs(F.col(in_dx) + F.col(out_dx)), F.abs(F.col(in_dy) + F.col(out_dy))) <= tolerance


def displacement(strips: DataFrame, best: DataFrame, least: int = 2, tolerance: int = 1) -> DataFrame:
    """One row for each strip with pairs: strip_id, margin (the least of its pairs) and flags, an array of frame, in_dx,
    in_dy, out_dx, out_dy: frames moved out and back; all frames of looping strips, inner ones of others, from 3 frames.
    """
    rows = best.groupBy("strip_id").agg(F.min("margin").alias("margin"), F.collect_list(F.struct("a", "b", "dx", "dy")).alias("moves")).join(strips.select("strip_id", "n", "loops"), "strip_id")
    last = F.when(F.col("loops"), F.col("n") - 1).otherwise(F.col("n") - 2)
    frames = F.when(F.col("n") >= 3, F.sequence(F.when(F.col("loops"), 0).otherwise(1), last))

    def move(k: Column) -> Column:
        into = F.get(F.filter("moves", lambda m: (m["b"] == k) & (m["a"] == F.pmod(k - 1, F.col("n")))), F.lit(0))
        out = F.get(F.filter("moves", lambda m: (m["a"] == k) & (m["b"] == F.pmod(k + 1, F.col("n")))), F.lit(0))
        return F.struct(k.cast("int").alias("frame"), into["dx"].alias("in_dx"), into["dy"].alias("in_dy"), out["dx"].alias("out_dx"), out["dy"].alias("out_dy"))

    far = lambda m: F.greatest(F.abs(m["in_dx"]), F.abs(m["in_dy"])) >= least
    back = lambda m: F.greatest(F.abs(m["in_dx"] + m["out_dx"]), F.abs(m["in_dy"] + m["out_dy"])) <= tolerance
    flags = F.filter(F.transform(frames, move), lambda m: m["in_dx"].isNotNull() & m["out_dx"].isNotNull() & far(m) & back(m))
    kind = "array<struct<frame:int,in_dx:int,in_dy:int,out_dx:int,out_dy:int>>"
    return rows.select("strip_id", "margin", F.coalesce(flags.cast(kind), F.array().cast(kind)).alias("flags"))


def displacement_flags(strips: DataFrame, best: DataFrame, least: int = 2, tolerance: int = 1) -> DataFrame:
    """(strip_id, frame, in_dx, in_dy, out_dx, out_dy): the flags of displacement, one row each."""
    return displacement(strips, best, least, tolerance).select("strip_id", F.explode("flags").alias("f")).select("strip_id", "f.*")
