"""The evidence graph: specification - promotion - attempt - measurement - provenance - raw file.

Each record is walked along its links by joins, one for each hop, and carries the first rule that it breaks: `reason`,
and `hop`, the kind of node at which it broke. Promotions are walked to the raw bytes and everything must be there and
agree; attempts without a promotion are history: what they name is compared where it still exists. A key that a table
has more than once is `ambiguous`, and counts as one record for what links to it, so no link doubles a row.

Tables: specifications(id, motion_class, target_gate, active_promotion), promotions(id, specification_id, attempt_id,
measurement_path, status), attempts(attempt_id, specification_id, artifact_state, measurement_path, provenance_path,
raw_sha256), measurements(path, motion_class, target_gate, raw_sha256), provenances(path, attempt_id, specification_id,
raw_path, raw_sha256), files(path, actual). A path without a row in the table of its kind is a missing file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPECIFICATION, PROMOTION, ATTEMPT = ("motion_class", "target_gate", "active_promotion"), ("specification_id", "status"), ("specification_id", "artifact_state", "provenance_path", "raw_sha256")
MEASUREMENT, PROVENANCE = ("motion_class", "target_gate", "raw_sha256"), ("attempt_id", "specification_id", "raw_path", "raw_sha256")

Rule = tuple[Column, str, str]


def hop(rows: DataFrame, node: DataFrame, key: str, on: str, fields: Sequence[str], name: str) -> DataFrame:
    """rows with a struct column `name`: the fields of the node that column `on` leads to and n, how many have its key;
    null if none."""
    one = node.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*fields)).alias("_f"), F.count("*").alias("n"))
    one = one.select("_key", F.struct("_f.*", "n").alias(name))
    return rows.join(one, F.col(on) == F.col("_key"), "left").drop("_key")


def _first(rules: Sequence[Rule]) -> tuple[Column, Column]:
    broken = F.coalesce(*(F.when(holds, F.struct(F.lit(code).alias("reason"), F.lit(kind).alias("hop"))) for holds, kind, code in rules))
    return broken["reason"], broken["hop"]


def _differ(a: str, b: str) -> Column:
    return ~F.col(a).eqNullSafe(F.col(b))


def _ambiguous(*names: str) -> list[Rule]:
    return [(F.col(f"{n}.n") > 1, n, "ambiguous") for n in names]


def _judged(rows: DataFrame, kind: str, ident: Column, rules: Sequence[Rule]) -> DataFrame:
    reason, at = _first(rules)
    return rows.select(F.lit(kind).alias("kind"), ident.cast("string").alias("id"), at.alias("hop"), reason.alias("reason"))


def check_specifications(specifications: DataFrame, promotions: DataFrame) -> DataFrame:
    """The active promotion must exist and be of this specification."""
    rows = hop(specifications, specifications, "id", "id", ("id",), "specification")
    rows = hop(rows, promotions, "id", "active_promotion", PROMOTION, "promotion")
    active = F.col("active_promotion").isNotNull()
    return _judged(rows, "specification", F.col("id"), [
        *_ambiguous("specification"), (active & F.col("promotion").isNull(), "promotion", "broken_reference"), *_ambiguous("promotion"),
        (active & _differ("promotion.specification_id", "id"), "promotion", "identity_specification"),
    ])


def check_promotions(promotions: DataFrame, specifications: DataFrame, attempts: DataFrame, measurements: DataFrame, provenances: DataFrame, files: DataFrame) -> DataFrame:
    """Deep: everything from the specification to the raw bytes must be there, agree and have the raw file's digest."""
    rows = hop(promotions.select("id", "specification_id", "attempt_id", "measurement_path"), promotions, "id", "id", ("id",), "promotion")
    rows = hop(rows, attempts, "attempt_id", "attempt_id", ATTEMPT, "attempt")
    rows = hop(rows, specifications, "id", "specification_id", SPECIFICATION, "specification")
    rows = hop(rows, measurements, "path", "measurement_path", MEASUREMENT, "measurement")
    rows = hop(rows, provenances, "path", "attempt.provenance_path", PROVENANCE, "provenance")
    rows = hop(rows, files, "path", "provenance.raw_path", ("actual",), "raw")
    hashes = [r for n in ("provenance", "measurement", "attempt") for r in ((F.col(f"{n}.raw_sha256").isNull(), n, "missing_hash"), (_differ(f"{n}.raw_sha256", "raw.actual"), n, "hash_mismatch"))]
    return _judged(rows, "promotion", F.col("id"), [
        *_ambiguous("promotion"), (F.col("attempt").isNull(), "attempt", "missing_attempt"), (F.col("specification").isNull(), "specification", "broken_reference"), *_ambiguous("attempt", "specification"),
        (_differ("specification_id", "attempt.specification_id"), "attempt", "identity_specification"), (F.col("attempt.artifact_state") == "discarded", "attempt", "discarded_candidate"),
        (F.col("measurement").isNull(), "measurement", "missing_file"), *_ambiguous("measurement"), (_differ("measurement.target_gate", "specification.target_gate"), "measurement", "identity_gate"), (_differ("measurement.motion_class", "specification.motion_class"), "measurement", "identity_class"),
        (F.col("attempt.provenance_path").isNull(), "provenance", "unnamed_file"), (F.col("provenance").isNull(), "provenance", "missing_file"), *_ambiguous("provenance"),
        (_differ("provenance.attempt_id", "attempt_id"), "provenance", "identity_attempt"), (_differ("provenance.specification_id", "attempt.specification_id"), "provenance", "identity_specification"),
        (F.col("raw").isNull(), "raw", "missing_file"), *hashes,
    ])


def check_attempts(attempts: DataFrame, measurements: DataFrame, provenances: DataFrame, files: DataFrame, strict: bool = True) -> DataFrame:
    """Lenient: named records must exist (where strict; a provenance only for retained attempts), and digests must agree
    with the raw file if that still exists."""
    rows = hop(attempts.select("attempt_id", "artifact_state", "measurement_path", "provenance_path", "raw_sha256"), attempts, "attempt_id", "attempt_id", ("attempt_id",), "attempt")
    rows = hop(rows, measurements, "path", "measurement_path", MEASUREMENT, "measurement")
    rows = hop(rows, provenances, "path", "provenance_path", PROVENANCE, "provenance")
    rows = hop(rows, files, "path", "provenance.raw_path", ("actual",), "raw")
    named = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    there, strict = F.col("raw").isNotNull(), F.lit(strict)
    return _judged(rows, "attempt", F.col("attempt_id"), [
        *_ambiguous("attempt"), (strict & named("measurement_path") & F.col("measurement").isNull(), "measurement", "missing_file"), *_ambiguous("measurement"),
        (there & _differ("provenance.raw_sha256", "raw.actual"), "provenance", "hash_mismatch"), (there & F.col("measurement").isNotNull() & _differ("measurement.raw_sha256", "raw.actual"), "measurement", "hash_mismatch"),
        (there & F.col("raw_sha256").isNotNull() & _differ("raw_sha256", "raw.actual"), "attempt", "hash_mismatch"),
        (strict & named("provenance_path") & F.col("provenance").isNull() & (F.col("artifact_state") == "retained"), "provenance", "missing_file"), *_ambiguous("provenance"),
    ])


def check_profiles(profiles: DataFrame, specifications: DataFrame, promotions: DataFrame) -> DataFrame:
    """profiles(motion_class, gate, status, active_promotion): a SEPARATED gate's promotion must be there, ACTIVE, and the
    one that the specification of its class and gate has."""
    rows = profiles.filter("status = 'SEPARATED' and active_promotion is not null").withColumn("_pair", F.struct("motion_class", "gate"))
    rows = hop(rows, promotions, "id", "active_promotion", PROMOTION, "promotion")
    rows = hop(rows, specifications.withColumn("_of", F.struct("motion_class", F.col("target_gate").alias("gate"))), "_of", "_pair", SPECIFICATION, "specification")
    return _judged(rows, "profile", F.concat_ws("/", "motion_class", "gate"), [
        (F.col("promotion").isNull(), "promotion", "missing_promotion"), *_ambiguous("promotion"), (F.coalesce(F.col("promotion.status") != "ACTIVE", F.lit(True)), "promotion", "not_active"),
        (F.col("specification").isNull(), "specification", "missing_specification"), *_ambiguous("specification"), (_differ("specification.active_promotion", "active_promotion"), "specification", "alternate_promotion"),
    ])


def check_graph(specifications: DataFrame, promotions: DataFrame, attempts: DataFrame, measurements: DataFrame, provenances: DataFrame, files: DataFrame, focus: DataFrame | None = None) -> DataFrame:
    """kind, id, hop and reason of every specification, promotion and attempt; hop and reason are null for sound ones.

    Attempts that back a promotion are judged with it. With focus(id), only those promotions are walked deep, named ids
    without a promotion are `unknown_promotion`, and history may lack what it names.
    """
    deep = promotions if focus is None else promotions.join(focus.select("id").distinct(), "id", "left_semi")
    history = attempts.join(deep.select("attempt_id").distinct(), "attempt_id", "left_anti")
    found = check_specifications(specifications, promotions).unionByName(check_promotions(deep, specifications, attempts, measurements, provenances, files))
    found = found.unionByName(check_attempts(history, measurements, provenances, files, focus is None))
    if focus is not None:
        unknown = focus.select("id").distinct().join(promotions.select("id"), "id", "left_anti")
        found = found.unionByName(unknown.select(F.lit("promotion").alias("kind"), F.col("id").cast("string").alias("id"), F.lit("promotion").alias("hop"), F.lit("unknown_promotion").alias("reason")))
    return found


def check_registration(claims: DataFrame, store: DataFrame, fields: Sequence[str] = ("generation_mode", "motion_class", "prompt_sha256")) -> DataFrame:
    """claims with `reason`: the first rule that the attempt a bundle claims breaks, null if it is registered.

    claims: attempt_id, provider_sha256 and the fields; store: attempt_id, place (order of its rows), raw_sha256, outcome,
    provenance (a struct of the fields, null if its record can't be read). The attempt must be in the store (its first
    row counts) with the provider's digest, not rejected, agree in all fields, and be the last row of that digest.
    """
    kept = store.filter("attempt_id is not null").groupBy(F.col("attempt_id").alias("_id")).agg(F.min(F.struct("place", "raw_sha256", "outcome", "provenance")).alias("row"))
    last = store.filter("raw_sha256 is not null").groupBy(F.col("raw_sha256").alias("_sha")).agg(F.max(F.struct("place", "attempt_id")).alias("last"))
    rows = claims.join(kept, F.col("attempt_id") == F.col("_id"), "left").join(last, F.col("provider_sha256") == F.col("_sha"), "left")
    reason = F.coalesce(
        F.when(F.col("row").isNull(), "not_in_store"), F.when(_differ("row.raw_sha256", "provider_sha256"), "digest_differs"), F.when(F.col("row.outcome") == "rejected", "rejected"),
        F.when(F.col("row.provenance").isNull(), "no_provenance"), *(F.when(_differ(f"row.provenance.{f}", f), f"{f}_differs") for f in fields), F.when(_differ("last.attempt_id", "attempt_id"), "not_the_last"),
    )
    return rows.select(*claims.columns, reason.alias("reason"))
