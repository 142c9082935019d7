"""Contiguous shards against running sums in plain Python, odd rows and files."""

import tempfile
import zlib

import pytest
from pyspark.sql import functions as F

from framegauge.llm.sharding import contiguous_shards, with_sizes, write_shards


def _plain(docs, shards):
    """(doc_id, size, crc, shard, slot) by one running sum."""
    rows = [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    total, before, slots, out = sum(r[1] for r in rows), 0, {}, []
    for r in rows:
        shard = (2 * before + r[1]) * shards // (2 * total)
        out.append((*r, shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        before += r[1]
    return out


def _shards(df, shards, **more):
    got = contiguous_shards(with_sizes(df).select("doc_id", "size", "text_crc32"), ("doc_id", "size", "text_crc32"), shards, **more)
    return sorted((tuple(r) for r in got.select("doc_id", "size", "text_crc32", "shard", "slot").collect()), key=repr)


@pytest.mark.parametrize(("shards", "partitions"), [(1, 3), (5, 2), (24, 7), (24, None), (90, 4)])
def test_equal_to_a_running_sum(spark, shards, partitions):
    docs = [(i * 3 % 101, "é" * (i % 13) + "a" * (i * i % 50)) for i in range(101)]
    assert _shards(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), shards, partitions=partitions) == sorted(_plain(docs, shards), key=repr)


def test_odd_rows(spark):
    docs = [(None, None), (None, "x"), (1, ""), (1, ""), (2, None), (3, "long " * 4000), *[(7, "same text")] * 40, (8, "a"), (9, "b")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert _shards(df, 6, partitions=4) == sorted(_plain(docs, 6), key=repr)
    assert _shards(df.filter("doc_id < 0"), 6) == []
    more = with_sizes(df.withColumns({"shard": F.lit("s"), "slot": F.lit(1), "size": F.lit("x"), "row": F.lit(2), "k0": F.lit(3), "own": F.lit(4), "_": F.lit(5), "bytes": F.lit(6)}))
    got = contiguous_shards(more.drop("_"), ("doc_id",), 6)
    assert set(got.columns) == {"doc_id", "text", "shard", "slot", "size", "text_crc32", "row", "k0", "own", "bytes"} and got.filter("row = 2 and k0 = 3 and own = 4 and bytes = 6").count() == len(docs)


def test_equal_rows_are_dealt_to_many_partitions(spark):
    """A third of all rows with one id and text neither makes a hot partition nor an uneven shard."""
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("0123456789").alias("text"))
    got = contiguous_shards(with_sizes(df), ("doc_id", "size", "text_crc32"), 10, partitions=8)
    assert {r["count"] for r in got.groupBy("shard").count().collect()} == {900}
    assert got.groupBy("shard").agg((F.max("slot") == 899).alias("a"), (F.count_distinct("slot") == 900).alias("b")).filter("a and b").count() == 10


def test_written_shards_hold_the_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = tempfile.mkdtemp(prefix="shards-") + "/out"
    write_shards(docs, "file://" + path, 5)
    back = spark.read.parquet("file://" + path)
    assert back.select(*docs.columns).exceptAll(docs).isEmpty() and back.count() == docs.count()
    sizes = [r["s"] for r in back.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= docs.agg(F.max(F.octet_length("text"))).first()[0] + 8
