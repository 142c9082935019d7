"""Documents to a training mix in five stages; each works on all rows that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns the columns of docs (the last one also n_tokens and copies, how
often the mix has the document). Cases: null and empty texts pass a stage unless it says otherwise; rows with a null
id are kept by the near-duplicate stage, since nothing can name them; rows that repeat an id are one document there;
further columns are carried along; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framegauge.llm.decontam import contaminated
from framegauge.llm.mixing import mix_sources
from framegauge.llm.near_dup import near_duplicates
from framegauge.llm.quality import fit_discriminant, keep_good, text_counts
from framegauge.llm.queries import domain, mixing_weights, table
from framegauge.llm.store import cut
from framegauge.llm.substring_dedup import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality scores 0.5 or more; learned from all labelled ones among them."""
    model = fit_discriminant(cut(text_counts(docs), "counts"), table(spark, sf_dir, "labels"), "quality")
    return keep_good(docs, model)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id."""
    kept = near_duplicates(docs).filter("kept and doc_id is not null").select(F.col("doc_id").alias("_kept")).distinct()
    named = docs.join(kept, docs.doc_id == kept["_kept"], "left_semi")
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    named = named.select(F.struct("*").alias("row"), nth.alias("nth")).filter("nth = 1").select("row.*")
    return named.unionByName(docs.filter("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that recur; documents of which nothing is left go."""
    left = remove_repeats(docs).filter("kept_text <> '' or n_words = 0")
    text = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return left.withColumns({c: e for c, e in text.items() if c in docs.columns}).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an item of the benchmark in them."""
    bad = cut(contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_key").distinct(), "contaminated")
    return docs.join(bad, F.xxhash64(docs.doc_id, docs.text) == bad.doc_key, "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: its documents with n_tokens and copies."""
    name = "domain"
    while name in docs.columns:
        name += "_"
    weights = mixing_weights(docs).withColumnsRenamed({"domain": name, "w_domain": f"w_{name}"})
    return mix_sources(docs.withColumn(name, domain()), weights, (name, "lang", "source")).drop(name)


STAGES = [("quality", quality), ("near duplicates", near_duplicate), ("repeated passages", repeated_passages), ("decontamination", decontamination), ("mixing", mixing)]
#: Learned models, automata and hashes have no SQL twin; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
