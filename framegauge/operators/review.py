"""Review: record rules, second-review triggers, packets of hash-bound roles, and blinding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evidence import first_reason, self_digest
from .gates import GATE_QUESTION

NO_HARD_FAIL = "no autonomous hard-fail reference exists for this Unseparated pair"
TRIGGERS = ("metric_at_or_beyond_midpoint", "multiple_gates_in_review", "first_verdict_uncertain", "caveat_reliance")


def record_rules(required: Sequence[str] = (), members: dict[str, Sequence[str]] | None = None, digests: Sequence[str] = (), optional_digests: Sequence[str] = ()) -> Column:
    """The first rule that a record breaks, in this order: missing_<f>, unknown_<f>, bad_digest_<f>; null if none."""
    missing = [(F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) == "", f"missing_{f}") for f in required]
    unknown = [(F.coalesce(~F.col(f).isin(*values), F.lit(True)), f"unknown_{f}") for f, values in (members or {}).items()]
    hexes = [(F.coalesce(~F.col(f).rlike("^[0-9a-f]{64}$"), F.lit(f in digests)), f"bad_digest_{f}") for f in (*digests, *optional_digests)]
    return first_reason(*missing, *unknown, *hexes)


def gates_in_review(outcomes: DataFrame) -> DataFrame:
    """outcomes(run_id, gate, outcome) with in_review: how many gates of the run are in REVIEW."""
    n = outcomes.groupBy("run_id").agg(F.count_if(F.col("outcome") == "REVIEW").alias("in_review"))
    return outcomes.join(n, "run_id")


def second_review_triggers(rows: DataFrame) -> DataFrame:
    """rows(metric, budget, hard_fail, in_review, first_verdict, caveated) with `triggers`, in their fixed order.

    The midpoint counts only where hard_fail lies over the budget; nulls pull no trigger.
    """
    band = (F.col("hard_fail") > F.col("budget")) & (F.col("metric") >= (F.col("budget") + F.col("hard_fail")) / 2)
    tests = [band, F.col("in_review") >= 2, F.col("first_verdict") == "UNCERTAIN", F.col("caveated")]
    found = F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for t, n in zip(tests, TRIGGERS, strict=True)))
    return rows.withColumn("triggers", F.filter(found, lambda x: x.isNotNull()))


def _role(name: str, path: str, digest: str) -> Column:
    return F.struct(F.col(path).alias("path"), F.col(digest).alias("raw_sha256"), F.lit(name).alias("role"))


def review_packets(attempts: DataFrame, measurements: DataFrame, provenance: DataFrame, files: DataFrame, profiles: DataFrame, goods: DataFrame, kind: str = "CANDIDATE_REVIEW", promotions: DataFrame | None = None) -> DataFrame:
    """A packet for each measured gate of each attempt: its roles, numbers, question and digest, or the reason for none.

    attempts: attempt_id, raw_sha256; measurements: attempt_id, motion_class, target_gate, gate, metric, budget, caveats;
    provenance: attempt_id, raw_path, raw_sha256; files: path, sha256 (the inventory); profiles: motion_class, gate,
    status, budget, hard_fail, active_promotion, control_attempt; goods: motion_class, gate, path, sha256 (the worst good
    sample's file); promotions: promotion_id, attempt_id, status. A candidate's packet carries the control of a
    SEPARATED pair, and for an UNSEPARATED one the reason why there is none. A PROMOTION_VERIFICATION packet has the
    candidate as its proposed hard-fail reference and needs a promotion of the attempt, on the gate that was measured for.
    Reasons, first one counts: missing_measurement, missing_provenance, missing_file, hash_mismatch, missing_profile,
    missing_control, unknown_promotion, identity_mismatch.
    """
    promoting = kind == "PROMOTION_VERIFICATION"
    rows = attempts.select("attempt_id", F.col("raw_sha256").alias("attempt_sha")).join(measurements, "attempt_id", "left")
    own = provenance.select("attempt_id", "raw_path", F.col("raw_sha256").alias("provenance_sha"))
    rows = rows.join(own, "attempt_id", "left").join(files.select(F.col("path").alias("raw_path"), F.col("sha256").alias("file_sha")), "raw_path", "left")
    entry = profiles.select("motion_class", "gate", "status", F.col("budget").alias("profile_budget"), "hard_fail", "active_promotion", "control_attempt")
    rows = rows.join(F.broadcast(entry), ["motion_class", "gate"], "left")
    rows = rows.join(F.broadcast(goods.select("motion_class", "gate", F.col("path").alias("good_path"), F.col("sha256").alias("good_sha"))), ["motion_class", "gate"], "left")
    control = own.select(F.col("attempt_id").alias("control_attempt"), F.col("raw_path").alias("control_path")).join(files.select(F.col("path").alias("control_path"), F.col("sha256").alias("control_sha")), "control_path")
    rows = rows.join(control, "control_attempt", "left")
    if promotions is not None:
        named = promotions.select("promotion_id", F.col("attempt_id").alias("promoted"), F.col("status").alias("promotion_status"))
        on = (F.col("promoted") == F.col("attempt_id")) if promoting else (F.col("promotion_id") == F.col("active_promotion"))
        rows = rows.join(named, on, "left")
    else:
        rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("promotion_id", "promoted", "promotion_status")})
    separated = F.coalesce(F.col("status") == "SEPARATED", F.lit(False))
    reason = first_reason(
        (F.col("gate").isNull(), "missing_measurement"), (F.col("raw_path").isNull(), "missing_provenance"), (F.col("file_sha").isNull(), "missing_file"),
        ((F.col("provenance_sha") != F.col("file_sha")) | F.coalesce(F.col("attempt_sha") != F.col("file_sha"), F.lit(False)), "hash_mismatch"), (F.col("status").isNull(), "missing_profile"),
        (F.lit(not promoting) & separated & F.col("control_sha").isNull(), "missing_control"), (F.lit(promoting) & F.col("promotion_id").isNull(), "unknown_promotion"),
        (F.lit(promoting) & (F.col("target_gate") != F.col("gate")), "identity_mismatch"),
    )
    question, panel = (F.element_at(F.create_map(*(F.lit(x) for g, v in GATE_QUESTION.items() for x in (g, v[i]))), F.col("gate")) for i in (0, 1))
    candidate = _role("candidate", "raw_path", "file_sha")
    rows = rows.withColumns({
        "budget": F.coalesce("profile_budget", "budget"), "candidate": candidate, "budget_binding_good": F.when(F.col("good_sha").isNotNull(), _role("budget_binding_good", "good_path", "good_sha")),
        "gate_control": F.when(F.lit(not promoting) & separated, _role("gate_control", "control_path", "control_sha")),
        "proposed_hard_fail_reference": F.when(F.lit(promoting), _role("proposed_hard_fail_reference", "raw_path", "file_sha")),
        "no_hard_fail_reason": F.when(F.lit(not promoting) & ~separated, F.concat_ws(" ", F.lit(NO_HARD_FAIL), F.concat_ws("/", "motion_class", "gate"))),
        "fixed_question": question, "panel_kind": panel, "packet_kind": F.lit(kind), "caveats": F.coalesce("caveats", F.array().cast("array<string>")),
    })
    fields = sorted((
        "attempt_id", "budget", "budget_binding_good", "candidate", "caveats", "fixed_question", "gate", "gate_control", "hard_fail", "metric", "motion_class",
        "no_hard_fail_reason", "packet_kind", "panel_kind", "promotion_id", "promotion_status", "proposed_hard_fail_reference",
    ))
    digest = F.when(reason.isNull(), self_digest(F.struct(*fields)))
    return rows.select(*fields, digest.alias("packet_sha256"), reason.alias("reason"))


def blinding_leaks(seconds: DataFrame, firsts: DataFrame) -> DataFrame:
    """What of a first review a second reviewer's input shows: same_review, same_reviewer, or the leaked field; null if none.

    seconds: packet, review_id, reviewer_identity, payload (the text that the second reviewer is given); firsts: packet,
    review_id, reviewer_identity, verdict, rationale. Empty values leak nothing. A packet without a first review has no row.
    """
    names = ("review_id", "reviewer_identity", "verdict", "rationale")
    rows = seconds.join(firsts.select("packet", *(F.col(c).alias(f"first_{c}") for c in names)), "packet")
    shown = lambda c: F.coalesce((F.col(f"first_{c}") != "") & F.contains(F.col("payload"), F.col(f"first_{c}")), F.lit(False))
    reason = first_reason(
        (F.col("review_id") == F.col("first_review_id"), "same_review"), (F.col("reviewer_identity") == F.col("first_reviewer_identity"), "same_reviewer"),
        (shown("verdict"), "verdict"), (shown("rationale"), "rationale"), (shown("review_id"), "review_id"),
    )
    return rows.select("packet", "review_id", reason.alias("leak"))
