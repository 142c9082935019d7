"""The queries of this subpackage: thin applications of its operators to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .centroids import cluster
from .decontam import contaminated
from .html_extract import extract_pages
from .language import learn_profiles, predict_language
from .mixing import mix_sources
from .near_dup import near_duplicates
from .oracles import ORACLES
from .quality import fit_discriminant, score_quality, text_counts
from .sharding import contiguous_shards, with_sizes
from .store import cut
from .substring_dedup import remove_repeats
from .toxicity import learn_toxicity, score_toxicity
from .vector_codes import compress
from .warc import archive_round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(folds: int, fold: int) -> Column:
    """Whether a row's crc32 of doc_id as text is in the fold kept out of learning; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = archive_round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def mixing_weights(docs: DataFrame) -> DataFrame:
    """Every source of docs in the tree of the registered mix: a domain by source name, English before other languages."""
    leaves = docs.select(*(F.coalesce(F.col(c), F.lit("unknown")).alias(c) for c in ("lang", "source"))).distinct()
    leaves = leaves.withColumn("domain", domain())
    w_domain = F.when(F.col("domain") == "first", 5).when(F.col("domain") == "second", 3).otherwise(2)
    w_lang = F.when(F.col("lang") == "en", 6).otherwise(2)
    return leaves.select("domain", "lang", "source", w_domain.alias("w_domain"), w_lang.alias("w_lang"), F.lit(1).alias("w_source"))


def domain() -> Column:
    number = F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) as int)")
    return F.when(number < 5, "first").when(number < 12, "second").otherwise("third")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").withColumn("domain", domain())
    mixed = mix_sources(docs, mixing_weights(docs))
    return mixed.select("doc_id", "domain", "lang", "source", "n_tokens", "copies")


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("doc_key")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = cut(text_counts(table(spark, sf_dir, "documents")), "counts")
    model = fit_discriminant(counts, table(spark, sf_dir, "labels").filter(~held_out(3, 1)), "quality")
    scored = score_quality(counts, model)
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    langs, prototypes = learn_profiles(docs.filter(~held_out(4, 2)))
    predicted = predict_language(docs, langs, prototypes)
    return predicted.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn_toxicity(docs, table(spark, sf_dir, "labels").filter(~held_out(3, 1)))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards in the order of doc_id, by the law of bytes."""
    docs = with_sizes(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return contiguous_shards(docs, ("doc_id", "size", "text_crc32")).withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_main_text, op2_warc, op3_mixing, op4_repeated_passages, op5_nearest, op6_decontamination, op7_quality, op8_language, op9_near_duplicates, op10_toxicity, op11_vector_codes, op12_centroids, op13_sharding)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
