"""Mixing where one leaf holds most rows, and where budgets are too many to be broadcast."""

from pyspark.sql import functions as F

from framegauge.llm import mixing


def _hot(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7).cast("int")).alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 9)).alias("source"), F.lit("d").alias("domain"))
    weights = docs.select("domain", "lang", "source").distinct().withColumns({"w_domain": F.lit(1), "w_lang": F.lit(1), "w_source": F.lit(1)})
    return docs, weights


def _rows(df):
    return sorted((r.doc_id, r.source, r.n_tokens, r.copies) for r in df.collect())


def test_ways_of_joining_budgets_agree(spark, monkeypatch):
    docs, weights = _hot(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        whole = mixing.mix_sources(docs, weights)
        want = _rows(whole)
        monkeypatch.setattr(mixing, "BROADCAST_LEAVES", 0)
        assert _rows(mixing.mix_sources(docs, weights)) == want
        monkeypatch.setattr(mixing, "GROUP_ROWS", 0.01)
        assert _rows(mixing.mix_sources(docs, weights)) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tokens_are_words(spark):
    texts = ["a b", " a\t\nb\x0b ", "", None, "  ", "é ü x"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").orderBy("i").select(mixing.token_count(F.col("text"))).collect()]
    assert got == [2, 2, 0, 0, 0, 2]
