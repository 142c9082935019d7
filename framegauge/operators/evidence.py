"""Evidence: hash bindings, linked records, quorum rules, contracts and comparisons of two runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_reason(*rules: tuple[Column, str]) -> Column:
    """Code of the first rule that holds, null if none does."""
    return F.coalesce(*(F.when(rule, F.lit(code)) for rule, code in rules))


def pairing(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and reason: null for complete pairs, else which side is missing."""
    both = left.select(*keys, F.lit(True).alias("_l")).distinct().join(right.select(*keys, F.lit(True).alias("_r")).distinct(), list(keys), "full_outer")
    return both.select(*keys, first_reason((F.col("_r").isNull(), "missing_sidecar"), (F.col("_l").isNull(), "missing_raw")).alias("reason"))


def binding_check(bindings: DataFrame, files: DataFrame, label: str) -> DataFrame:
    """bindings(id, path, digest) against files(path, actual): path_escape, missing or mismatch, each with the label."""
    # merged, since files are planned at their compressed size and would be broadcast through the driver
    rows = bindings.join(files.hint("merge"), "path", "left")
    reason = first_reason((escapes(F.col("path")), f"path_escape_{label}"), (F.col("actual").isNull(), f"missing_{label}"), (F.col("actual") != F.col("digest"), f"mismatch_{label}"))
    return rows.select("id", reason.alias("reason"))


def evidence_bindings(bundles: DataFrame, files: DataFrame, labels: Sequence[str], needed: Sequence[str]) -> DataFrame:
    """First broken binding of each bundle, in the order of labels: missing_binding_<l>, or binding_check's reasons; null if none.

    bundles: bundle_id and, for each label l, <l>_path and <l>_sha; files: path, actual. needed labels must be bound.
    """
    items = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(x).alias("label"), F.col(f"{x}_path").alias("path"), F.col(f"{x}_sha").alias("digest")) for i, x in enumerate(labels)))
    rows = bundles.select("bundle_id", F.explode(items).alias("b")).select("bundle_id", "b.*").join(files, "path", "left")
    bound = F.col("path").isNotNull() & F.col("digest").isNotNull()
    code = first_reason(
        (~bound & F.col("label").isin(*needed), "missing_binding"), (bound & escapes(F.col("path")), "path_escape"), (bound & F.col("actual").isNull(), "missing"), (bound & (F.col("actual") != F.col("digest")), "mismatch"))
    bad = rows.withColumn("code", code).filter("code is not null").groupBy("bundle_id").agg(F.min(F.struct("ord", F.concat_ws("_", "code", "label").alias("reason"))).alias("f"))
    return bundles.select("bundle_id").join(bad, "bundle_id", "left").select("bundle_id", "f.reason")


def allow_listed(bundles: DataFrame, allowed: DataFrame, keys: Sequence[str] = ("specification_id", "provider_sha256")) -> DataFrame:
    """The bundles whose keys the legacy list has."""
    return bundles.join(allowed.select(*keys).distinct(), list(keys), "left_semi")


def escapes(path: Column) -> Column:
    """Whether a path leaves its root: an absolute path, or one with `..` as a segment."""
    return path.startswith("/") | path.rlike("(^|[/\\\\])\\.\\.([/\\\\]|$)")


def quorum(reviews: DataFrame, needed: int = 2) -> DataFrame:
    """reviews(id, reviewer, packet, verdict): ACTIVE with enough distinct reviewers on one packet who all approve."""
    rows = reviews.groupBy("id").agg(F.count_distinct("reviewer").alias("reviewers"), F.count_distinct("packet").alias("packets"), F.bool_and(F.col("verdict") == "APPROVE").alias("agree"))
    reason = first_reason((F.col("reviewers") < needed, "too_few_reviewers"), (F.col("packets") > 1, "packet_mismatch"), (~F.col("agree"), "not_approved"))
    return rows.select("id", F.when(reason.isNull(), "ACTIVE").otherwise("INVALIDATED").alias("status"), reason.alias("reason"))


def question_quorum(answers: DataFrame, questions: Sequence[str]) -> DataFrame:
    """answers(id, reviewer, question, answer): needed reviewers, missing questions, and what is left unresolved."""
    rows = answers.groupBy("id").agg(F.count_distinct("reviewer").alias("reviewers"), F.collect_set("question").alias("asked"), F.count_if(F.col("answer").isin("EDIT", "UNCERTAIN")).alias("open"))
    missing = F.size(F.array_except(F.array(*(F.lit(q) for q in questions)), "asked"))
    needed = F.when(F.col("open") > 0, 2).otherwise(1)
    status = F.when(missing > 0, "INCOMPLETE").when(F.col("reviewers") < needed, "WAITING").when(F.col("open") > 0, "UNRESOLVED").otherwise("PASS")
    return rows.select("id", needed.alias("needed"), missing.alias("missing"), "open", status.alias("status"))


def contract(results: DataFrame, expectations: DataFrame) -> DataFrame:
    """results(id, tripped array) against expectations(id, expect, wanted array of `a|b` groups)."""
    rows = expectations.join(results.withColumn("_seen", F.lit(True)), "id", "left")
    hit = F.forall("wanted", lambda w: F.arrays_overlap(F.split(w, "\\|"), F.coalesce("tripped", F.array().cast("array<string>"))))
    state = F.when(F.col("_seen").isNull(), "pending").when(F.when(F.col("expect") == "PASS", F.size("tripped") == 0).otherwise((F.size("tripped") > 0) & hit), "agrees").otherwise("regression")
    return rows.select("id", state.alias("state"))


def divergence(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Rows that two runs judge differently."""
    rows = a.select(key, F.col(value).alias("first")).join(b.select(key, F.col(value).alias("second")), key)
    return rows.filter(~F.col("first").eqNullSafe(F.col("second")))


def projection_mismatches(a: DataFrame, b: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """keys and the names of the fields in which two projections differ (all of them where one side is missing)."""
    left, right = a.select(*keys, F.struct(*fields).alias("_a")), b.select(*keys, F.struct(*fields).alias("_b"))
    rows = left.join(right, list(keys), "full_outer")
    alone = F.col("_a").isNull() | F.col("_b").isNull()
    bad = F.filter(F.array(*(F.when(alone | ~F.col(f"_a.{f}").eqNullSafe(F.col(f"_b.{f}")), F.lit(f)) for f in fields)), lambda x: x.isNotNull())
    return rows.select(*keys, F.explode(bad).alias("field"))


def worst_good(metrics: DataFrame, keys: Sequence[str], value: str, ident: str) -> DataFrame:
    """The worst value of each cohort, the sample that binds it (the first on ties), and the best value as floor."""
    rows = metrics.groupBy(*keys).agg(F.min(F.struct((-F.col(value)).alias("m"), F.col(ident).alias("id"))).alias("w"), F.min(value).alias("floor"))
    return rows.select(*keys, (-F.col("w.m")).alias("worst"), F.col("w.id").alias("binding"), "floor")


def self_digest(record: Column) -> Column:
    """SHA-256 of a record's JSON without its own digest, nulls kept; fields must stand in order of their names."""
    return F.sha2(F.to_json(record, {"ignoreNullFields": "false"}), 256)
