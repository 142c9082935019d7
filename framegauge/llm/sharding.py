"""Contiguous shards of about equal size, with DataFrame functions only.

Rows get a place in one total order: they are dealt to partitions by ranges of the order columns (a number of their own
splits rows that are equal in all of them, however many), sorted inside, and written with their place. Bytes and rows
are added up by partition; running sums over these few totals give each partition its first byte and row. Shard k of n
starts with the first row whose middle is at or beyond byte k * total / n, so a cut is at most half a row off its
target. A partition that lies between two targets belongs to one shard as a whole; only in those that hold a target
(at most n - 1) rows are added up one by one to find the cut. Every row then finds its shard from its partition's list of
cuts, and its slot from its place: no row is dealt by shard, and no task gets a shard.

What is broadcast has a row for each partition of the range exchange (`partitions`, a parameter) and an entry for each
shard. All sums are exact: bytes as 64-bit numbers, their products with n as decimals.

Cases: null texts have no bytes, and all rows have `overhead` bytes more; null order columns come first; rows that are
equal in all order columns are any order among themselves; a row larger than a shard's share leaves shards empty; fewer
rows than shards too; an empty table gives an empty result; other columns are carried along, and those named like the
result's are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import cut

#: Bits of a place that count rows inside a partition.
ROW_BITS = 33


def with_sizes(docs: DataFrame, text_col: str = "text", overhead: int = 8) -> DataFrame:
    """docs with size (bytes of the text in UTF-8, and overhead) and text_crc32."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({"size": (F.octet_length(text) + overhead).cast("long"), "text_crc32": F.crc32(text.cast("binary"))})


def contiguous_shards(rows: DataFrame, order: Sequence[str], shards: int = 24, size_col: str = "size", partitions: int | None = None) -> DataFrame:
    """rows with shard (from 0) and slot (place inside its shard, from 0), shards contiguous in the order columns."""
    partitions = partitions or max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards)
    keys = [f"k{i}" for i in range(len(order))]
    carried = F.struct(F.lit(0).alias("_"), *(F.col(c) for c in rows.columns if c not in ("shard", "slot"))).alias("row")
    named = rows.select(carried, *(F.col(c).alias(k) for k, c in zip(keys, order, strict=True)), F.col(size_col).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("own"))
    sorted_rows = cut(named, "sizes").repartitionByRange(partitions, *keys, "own").sortWithinPartitions(*keys, "own")
    placed = cut(sorted_rows.select("row", "bytes", F.monotonically_increasing_id().alias("place")), "places")
    placed = placed.withColumns({"part": F.shiftright("place", ROW_BITS), "nth": F.col("place").bitwiseAND((1 << ROW_BITS) - 1)})

    def shard_of(doubled: str) -> Column:
        """The shard of the byte of which this is twice the number."""
        return F.expr(f"cast(cast({doubled} as decimal(38,0)) * {shards} div (cast(total as decimal(38,0)) * 2) as int)")

    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("part").agg(F.sum("bytes").alias("part_bytes"), F.count("*").alias("part_rows"))
    parts = parts.select("part", "part_bytes", *(F.coalesce(F.sum(f"part_{c}").over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("bytes", "rows")), F.sum("part_bytes").over(Window.partitionBy(F.lit(0))).alias("total"))
    parts = cut(parts.withColumns({"first": shard_of("2 * bytes_before"), "last": shard_of("2 * (bytes_before + part_bytes) - 1")}), "partitions")

    inside = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    split = placed.select("part", "nth", "bytes").join(F.broadcast(parts.filter("first < last")), "part")
    split = split.withColumn("start", F.col("bytes_before") + F.coalesce(F.sum("bytes").over(inside), F.lit(0)))
    pieces = split.select("part", "rows_before", "nth", shard_of("2 * start + bytes").alias("shard")).groupBy("part", "rows_before", "shard").agg(F.min("nth").alias("nth"))
    pieces = pieces.unionByName(parts.filter("first = last").select("part", "rows_before", F.col("first").alias("shard"), F.lit(0).cast("long").alias("nth")))
    pieces = pieces.withColumn("opens", F.min(F.col("rows_before") + F.col("nth")).over(Window.partitionBy("shard")))
    by_part = pieces.groupBy("part", "rows_before").agg(F.array_sort(F.collect_list(F.struct("nth", "shard", "opens"))).alias("pieces"))

    own = F.element_at(F.filter("pieces", lambda p: p["nth"] <= F.col("nth")), -1)
    found = placed.join(F.broadcast(by_part), "part").select("row", own.alias("own"), (F.col("rows_before") + F.col("nth")).alias("at"))
    return found.select("row.*", F.col("own.shard").alias("shard"), (F.col("at") - F.col("own.opens")).alias("slot")).drop("_")


def write_shards(docs: DataFrame, path: str, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write whole documents with size, text_crc32 and slot under path/shard=<number>, slots ascending in each file."""
    sized = with_sizes(docs, text_col)
    contiguous_shards(sized, (id_col, "size", "text_crc32"), shards).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
