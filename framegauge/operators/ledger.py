"""Ordered ledgers: dense ordinals, streaks, chains, projections, change detection, running sums and rolling statistics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut


#: Up to so many keys (by count) a table of one row a key is broadcast; beyond, rows are joined by key and salt.
BROADCAST_KEYS, SALTS = 200_000, 32


def scanned(rows: DataFrame, key: str, order: Sequence[str], what: Column | None = None, add: Column | None = None) -> DataFrame:
    """rows with _place (number from 1 within the key in this order), _before (struct `what` of the row before, null for
    a key's first row) and _sum (running sum of `add`). order must tell rows of a key apart.

    A segmented scan: rows are dealt by range of key and order and written, so a key of any size is spread over tasks.
    A range is scanned by itself and reduces, for each key in it, to a carry (rows, sum, last row); carries are combined
    along a key's ranges and handed to the ranges after. Only a key that goes on into a range has a carry there, so
    there is one a range at most.
    """
    what, add = what if what is not None else F.struct(F.lit(1).alias("_")), add if add is not None else F.lit(0)
    ranges = rows.withColumns({"_what": what, "_add": add}).repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id())
    ranges = cut(ranges, "ranges")  # written, so that ranges stay what they are
    ends = ranges.groupBy("_range", F.col(key).alias("_key")).agg(F.count("*").alias("_n"), F.sum("_add").alias("_s"), F.max_by("_what", F.struct(*order)).alias("_last"))
    along = Window.partitionBy("_key").orderBy("_range")
    so_far = along.rowsBetween(Window.unboundedPreceding, -1)
    carries = ends.select("_range", "_key", F.sum("_n").over(so_far).alias("_rows"), F.sum("_s").over(so_far).alias("_carried"), F.lag("_last").over(along).alias("_handed")).filter("_rows is not null").withColumnRenamed("_range", "_in")
    inside = Window.partitionBy("_range", key).orderBy(*order)
    own = ranges.withColumns({"_nth": F.row_number().over(inside), "_lag": F.lag("_what").over(inside), "_upto": F.sum("_add").over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    joined = own.join(F.broadcast(carries), (F.col("_range") == F.col("_in")) & F.col(key).eqNullSafe(F.col("_key")), "left")
    zero = F.lit(0)
    return joined.withColumns({
        "_place": (F.col("_nth") + F.coalesce("_rows", zero)).cast("long"), "_before": F.when(F.col("_nth") == 1, F.col("_handed")).otherwise(F.col("_lag")), "_sum": F.col("_upto") + F.coalesce("_carried", zero),
    }).drop("_what", "_add", "_range", "_in", "_key", "_rows", "_carried", "_handed", "_nth", "_lag", "_upto")


def with_key(rows: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with a table of one row a key, without bringing a key's rows together."""
    named = small.withColumnRenamed(key, "_key")
    same = F.col(key).eqNullSafe(F.col("_key"))
    if named.count() <= BROADCAST_KEYS:
        return rows.join(F.broadcast(named), same, how).drop("_key")
    salted = named.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mine = rows.withColumn("_own", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return mine.join(salted, same & (F.col("_own") == F.col("_salt")), how).drop("_key", "_own", "_salt")


def dense_violations(rows: DataFrame, key: str, position: str, ordinal: str) -> DataFrame:
    """Rows whose ordinal is not their place (from 1) in file order."""
    return placed(rows, key, [position]).withColumnRenamed("place", "expected").filter(~F.col(ordinal).eqNullSafe(F.col("expected")))


def next_ordinal(rows: DataFrame, key: str, ordinal: str, ident: str, position: str | None = None, counters: DataFrame | None = None) -> DataFrame:
    """For each key the next ordinal, over the ledger's and the counter's largest, and the last row's id as predecessor.

    counters(key, counter) may know keys without rows, whose predecessor is null; with position, the later of two rows
    with the largest ordinal is the predecessor.
    """
    last = F.struct(ordinal, position) if position else F.col(ordinal)
    out = rows.groupBy(key).agg(F.max(ordinal).alias("_most"), F.max_by(ident, last).alias("predecessor"))
    if counters is not None:
        out = out.join(counters.groupBy(key).agg(F.max("counter").alias("_counter")), key, "full_outer")
    else:
        out = out.withColumn("_counter", F.lit(None).cast("long"))
    return out.select(key, (F.greatest(F.coalesce("_most", F.lit(0)), F.coalesce("_counter", F.lit(0))) + 1).alias("next_ordinal"), "predecessor")


def trailing_streak(rows: DataFrame, key: str, order: Sequence[str], code: str, escalate: int = 3) -> DataFrame:
    """Length of the run of one code at each key's end; a null code is a run of none."""
    marked = scanned(rows, key, order, F.struct(F.col(code).alias("c")))
    starts = F.col("_before").isNull() | ~F.col("_before.c").eqNullSafe(F.col(code))
    ends = marked.groupBy(key).agg(F.max_by(code, "_place").alias("code"), F.max("_place").alias("_last"), F.max(F.when(starts, F.col("_place"))).alias("_start"))
    out = ends.select(key, "code", F.when(F.col("code").isNull(), 0).otherwise(F.col("_last") - F.col("_start") + 1).cast("long").alias("streak"))
    return out.withColumn("escalate", F.col("streak") >= escalate)


def chain_violations(rows: DataFrame, key: str, order: str, ident: str, predecessor: str, state: str) -> DataFrame:
    """First broken rule for each key, null if none: ids unique, predecessors are the row before, only the last selected."""
    twice = rows.groupBy(key, ident).agg(F.count("*").alias("_n")).groupBy(key).agg((F.max("_n") > 1).alias("_twice"))
    marked = scanned(rows, key, [order], F.struct(F.col(ident).alias("i")))
    picked = F.col(state) == "selected"
    found = marked.groupBy(key).agg(
        F.bool_or(~F.col(predecessor).eqNullSafe(F.col("_before.i"))).alias("_unlinked"), F.count_if(picked).alias("_picked"),
        F.bool_or(F.when(picked, F.lit(True))).alias("_any"), F.max(F.when(picked, F.col("_place"))).alias("_at"), F.min(F.when(picked, F.col("_place"))).alias("_first"), F.max("_place").alias("_last"))
    rules = [("_twice", "duplicate_id"), ("_unlinked", "predecessor_mismatch"), ("_picked <> 1", "not_one_selected"), ("_first < _last", "selected_not_last")]
    reason = F.coalesce(*(F.when(F.expr(r), F.lit(c)) for r, c in rules))
    return found.join(twice.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key"))).select(key, reason.alias("reason"))


def project_prefix(rows: DataFrame, key: str, order: str, selected: Column) -> DataFrame:
    """Rows up to and including the last selected one of each key; keys without one give none."""
    upto = rows.filter(selected).groupBy(key).agg(F.max(order).alias("_upto"))
    return with_key(rows, upto, key).withColumn("selected", F.col(order) == F.col("_upto")).filter(F.col(order) <= F.col("_upto")).drop("_upto")


def changes(rows: DataFrame, key: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Rows that differ from the one before in any field; the first row of a key always does."""
    now = F.struct(*fields)
    marked = scanned(rows, key, order, now)
    return marked.filter(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(now)).drop("_place", "_before", "_sum")


def running_sums(rows: DataFrame, key: str, order: Sequence[str], value: str, name: str) -> DataFrame:
    """rows with the sum of value over the key's rows up to each, in this order."""
    return scanned(rows, key, order, add=F.col(value)).withColumn(name, F.col("_sum")).drop("_place", "_before", "_sum")


def placed(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """rows with `place`, the row's number (from 1) within its key in this order; order must tell rows of a key apart."""
    return scanned(rows, key, order).withColumnRenamed("_place", "place").drop("_before", "_sum")


def rolling_stats(rows: DataFrame, key: str, order: Sequence[str], value: str, size: int = 120, at: str | None = None, chunk: int = 4096) -> DataFrame:
    """Nearest-rank p50 and p95 and the maximum of the last `size` values, and with at the step from the row before.

    A key's rows are cut into chunks of so many, each with the size - 1 rows before it (one at least), so that no task
    gets a whole key.
    """
    lead = max(size - 1, 1)
    rows = placed(rows, key, order)
    own = F.expr(f"(place - 1) div {chunk}")
    # the last rows of a chunk also lead the next one
    both = F.when((F.col("place") - 1) % chunk >= chunk - lead, F.array(own, own + 1)).otherwise(F.array(own)) if lead < chunk else F.sequence(own, F.expr(f"(place - 1 + {lead}) div {chunk}"))
    spread = rows.withColumn("_own", own).withColumn("_chunk", F.explode(both))
    w = Window.partitionBy(key, "_chunk").orderBy("place")
    marked = spread.withColumn("_ring", F.array_sort(F.collect_list(value).over(w.rowsBetween(-(size - 1), 0))))
    if at:
        marked = marked.withColumn("step", F.col(at) - F.lag(at).over(w))
    rank = lambda p: F.get(F.col("_ring"), (F.ceil(F.size("_ring") * p) - 1).cast("int"))
    marked = marked.filter(F.col("_chunk") == F.col("_own"))
    return marked.withColumns({"p50": rank(0.5), "p95": rank(0.95), "top": F.array_max("_ring")}).drop("_ring", "_own", "_chunk", "place")


def percentiles(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Nearest-rank p50 and p95 and the maximum for each key, by places, so that no key's values meet in one buffer.

    Equal values are counted first; null values are left out.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_c"))
    ranges = cut(counts.repartitionByRange(key, value).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranges.groupBy("_range", key).agg(F.sum("_c").alias("_n"))
    upto = Window.partitionBy(key).orderBy("_range")
    offsets = sums.select("_range", key, (F.sum("_n").over(upto.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(key)).alias("_all"))
    inside = F.sum("_c").over(Window.partitionBy("_range", key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ends = ranges.withColumn("_end", inside).join(offsets, ["_range", key]).withColumn("_end", F.col("_end") + F.col("_before"))
    # a value has the ranks up to its end
    at = lambda p: F.min(F.when(F.col("_end") >= F.ceil(F.col("_all") * p), F.col(value)))
    return ends.groupBy(key).agg(at(0.5).alias("p50"), at(0.95).alias("p95"), F.max(value).alias("top"))


def thin(rows: DataFrame, key: str, at: str, ident: str, gap: float = 60.0) -> DataFrame:
    """Rows at least `gap` after the last kept row of their key, in order of at and ident.

    Which rows are kept depends on all rows before, so a key's rows pass through one task, sorted (which spills) and
    batch by batch; what is held is the last kept time. Rows with a null time are left out.
    """
    own = rows.select(F.col(key).alias("k"), F.col(at).cast("double").alias("at"), F.col(ident).alias("i")).filter("at is not null")
    types = dict(own.dtypes)

    def fold(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = object(), 0.0
        for batch in it:
            keys, times, keep, i = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [], 0
            for i, (k, t) in enumerate(zip(keys, times, strict=True)):
                if k != now or t - last >= gap:
                    keep.append(i)
                    now, last = k, t
            yield batch.take(pa.array(keep, pa.int64())).select([0, 2])

    kept = own.repartition("k").sortWithinPartitions("k", "at", "i").mapInArrow(fold, f"k {types['k']}, i {types['i']}")
    return kept.select(F.col("k").alias(key), F.col("i").alias(ident))


LEDGER_VIEW = ("attempt_id", "predecessor_attempt_id", "outcome", "rejection_reason", "prompt_sha256", "raw_sha256", "selected")


def attestation(bundles: DataFrame, committed: DataFrame, store: DataFrame, allowed: DataFrame, view: Sequence[str] = LEDGER_VIEW) -> DataFrame:
    """State of each bundle: cell-author, legacy, attested, attempt_not_registered or attempt_ledger_not_attested.

    bundles: bundle_id, specification_id, provider_sha256, attempt_id, cell_authored; committed: bundle_id, ord and the
    view's fields (the ledger in the bundle); store: specification_id, ord and the view's fields but `selected`; allowed:
    specification_id, provider_sha256. The store's rows up to the bundle's attempt, that one selected, must equal the
    committed rows in order.
    """
    fields = [f for f in view if f != "selected"]
    lists = committed.groupBy("bundle_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*view).alias("row")))), lambda x: x["row"]).alias("own"))
    rows = bundles.join(store, "specification_id").withColumns({"mine": store["attempt_id"] == bundles["attempt_id"]}).select("bundle_id", "ord", "mine", *(store[f] for f in fields))
    rows = rows.withColumn("upto", F.min(F.when(F.col("mine"), F.col("ord"))).over(Window.partitionBy("bundle_id"))).filter(F.col("ord") <= F.col("upto")).withColumn("selected", F.col("ord") == F.col("upto"))
    projected = rows.groupBy("bundle_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*view).alias("row")))), lambda x: x["row"]).alias("wanted"))
    legacy = allowed.select("specification_id", "provider_sha256", F.lit(True).alias("legacy")).distinct()
    out = bundles.join(legacy, ["specification_id", "provider_sha256"], "left").join(lists, "bundle_id", "left").join(projected, "bundle_id", "left")
    state = (
        F.when(F.col("cell_authored"), "cell-author").when(F.col("legacy"), "legacy").when(F.col("wanted").isNull(), "attempt_not_registered")
        .when(F.col("own").eqNullSafe(F.col("wanted")), "attested").otherwise("attempt_ledger_not_attested")
    )
    return out.select("bundle_id", state.alias("state"))


def reset_slices(promotions: DataFrame, slices: DataFrame, promotion: str, status: str) -> DataFrame:
    """promotions(id, status) as they stood when one promotion got its status: later slices pending, its own slice set.

    slices: id and slice (a number); promotions without a slice, and earlier slices, stay as they are. A promotion
    without a slice changes itself only.
    """
    at = slices.filter(F.col("id") == promotion).agg(F.max("slice").alias("at"))
    rows = promotions.join(slices, "id", "left").crossJoin(F.broadcast(at))
    new = (
        F.when(F.col("at").isNull(), F.when(F.col("id") == promotion, F.lit(status)).otherwise(F.col("status")))
        .when(F.col("slice") > F.col("at"), "PENDING_VERIFICATION").when(F.col("slice") == F.col("at"), F.lit(status)).otherwise(F.col("status"))
    )
    return rows.select("id", new.alias("status"))


def offline_summary(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """What a session gained while away, from the two snapshots (advance, ingots, ore, bagOre, heapOre)."""
    names = ("advance", "ingots", "ore", "bagOre", "heapOre")
    both = before.select(key, *(F.col(c).alias(f"b_{c}") for c in names)).join(after.select(key, *names), key)
    gained = {c: F.col(c) - F.col(f"b_{c}") for c in names}
    produced = gained["ore"] + gained["bagOre"] + gained["heapOre"] + gained["ingots"]
    return both.select(key, gained["advance"].alias("advance_gained"), gained["ingots"].alias("ore_smelted"), produced.alias("ore_produced"), F.col("ore").alias("ore_backlog"))


def append_once(existing: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Rows of the batch whose key the ledger has not yet; a key that repeats in the batch enters once, with its first row."""
    first = Window.partitionBy(key).orderBy(*(F.col(c) for c in batch.columns if c != key))
    new = batch.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return new.join(existing.select(key), key, "left_anti")


def status_update(rows: DataFrame, updates: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """rows with the new status where updates name one, and the updates that were refused: key and reason.

    An update of a key that rows lack is `unknown_key`; one of a key with two different statuses is `conflict`, and
    changes nothing. The same update twice counts once.
    """
    new = updates.groupBy(key).agg(F.max("status").alias("_new"), F.min("status").eqNullSafe(F.max("status")).alias("_one"))
    out = rows.join(new, key, "left").withColumn("status", F.when(F.col("_one"), F.coalesce("_new", "status")).otherwise(F.col("status"))).drop("_new", "_one")
    known = new.join(rows.select(key, F.lit(True).alias("_known")).distinct(), key, "left")
    reason = F.when(F.col("_known").isNull(), "unknown_key").when(~F.col("_one"), "conflict")
    return out, known.select(key, reason.alias("reason")).filter("reason is not null")
