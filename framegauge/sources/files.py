"""File sources and sinks: inventories, tagged documents, reviews, reports and releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """path below root and SHA-256 of every file at any depth; Spark's readers pass over empty files, so those have no row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.split("://", 1)[-1].split(":", 1)[-1].rstrip("/") + "/"
    return files.select(F.substring_index("path", base, -1).alias("path"), F.sha2("content", 256).alias("sha256"))


def tagged_documents(spark: SparkSession, root: str, schema: str, known: list[str], glob: str = "*.json") -> DataFrame:
    """JSON records at any depth with their tag checked: reason is null, unreadable or unknown_schema."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).json(root)
    reason = F.when(F.col("_corrupt_record").isNotNull(), "unreadable").when(~F.coalesce(F.col("schema").isin(*known), F.lit(False)), "unknown_schema")
    return rows.withColumn("reason", reason).withColumn("stem", F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)\\.[^./]+$", 1))


def reviews(rows: DataFrame) -> DataFrame:
    """review_id falls back to the stem of the record's file."""
    return rows.withColumn("review_id", F.coalesce("review_id", "stem"))


def write_report(reports: DataFrame, path: str) -> None:
    """Reports by outcome; an existing report is never overwritten."""
    reports.write.mode("errorifexists").partitionBy("outcome").parquet(path)


def releases(reports: DataFrame, released: DataFrame, key: str) -> DataFrame:
    """PASS rows to release; those that are there under another hash are conflicts."""
    rows = reports.filter("outcome = 'PASS'").join(released.select(key, F.col("sha").alias("_there")), key, "left")
    return rows.withColumn("reason", F.when(F.col("_there") != F.col("sha"), "release_conflict")).drop("_there")
