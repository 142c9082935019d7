"""Evidence records from JSON files. Nothing is dropped: a record that breaks a rule keeps its row, with the first broken
rule as `reason`; rows of good records have a null reason. A document of many entries that can't be read, is of an
unknown schema or has no entries gives one row without an entry, with that reason.

Each scan takes a path (file, folder or glob; folders at any depth) and the schema tags that it knows. A document may be
one line of a file (lines=True, blank lines are skipped) or a whole file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.evidence import first_reason

# Schema tags of the records.
ATTEMPT_TAGS, MANIFEST_TAGS, PROFILE_TAGS = ("gate-control-acquisition/0",), ("gate-control-manifest/0",), ("acceptance-profile-index/0",)
MEASUREMENT_TAGS, PROVENANCE_TAGS = ("gate-control-measurement/0", "gate-control-measurement/1"), ("gate-control-provenance/0",)
ATTEMPT = "schema string, attempt_id string, specification_id string, ordinal int, artifact_state string, isolation string, measurement_path string, provenance_path string, composite_path string, raw_sha256 string, recorded_at string"
SPECIFICATION = "id string, motion_class string, target_gate string, active_promotion string"
PROMOTION = "id string, specification_id string, attempt_id string, measurement_path string, status string, recorded_at string, note string"
PROFILE = "status string, budget variant, hard_fail variant, active_promotion string, control_attempt string, evidence_attempt string"
GATE = "applicable_because string, outcome string, metric double, budget double, reason string"
MEASUREMENT = f"schema string, raw_sha256 string, motion_class string, target_gate string, isolation string, caveats array<string>, gates map<string, struct<{', '.join(f.replace(' ', ': ') for f in GATE.split(', '))}>>"
PROVENANCE = "schema string, specification_id string, attempt_id string, raw_path string, raw_sha256 string"


def _struct(fields: str) -> str:
    return "struct<" + ", ".join(f.replace(" ", ": ", 1) for f in fields.split(", ")) + ">"


def documents(spark: SparkSession, path: str, schema: str, known: Sequence[str] | None, lines: bool = False, glob: str = "*") -> DataFrame:
    """The fields of schema for each document, its file's stem, a hash of its text as `document`, and a reason: unreadable,
    missing_schema or unknown_schema (documents without tags have known = None)."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("wholetext", not lines).text(path)
    rows = text.select(F.regexp_extract("_metadata.file_path", "([^/]+?)(?:\\.[^./]+)?$", 1).alias("stem"), "value").filter(F.trim("value") != "")
    rows = rows.withColumn("d", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    tags = [] if known is None else [(F.col("schema").isNull(), "missing_schema"), (~F.col("schema").isin(*known), "unknown_schema")]
    reason = first_reason((F.col("_bad").isNotNull(), "unreadable"), *tags)
    return rows.select("stem", F.xxhash64("value").alias("document"), "d.*").withColumn("reason", reason).drop("_bad")


def required(*fields: str) -> list[tuple[Column, str]]:
    """Rules: each of the fields must be there and not empty."""
    return [(F.coalesce(F.col(f), F.lit("")) == "", f"missing_{f}") for f in fields]


def optional(*fields: str) -> list[tuple[Column, str]]:
    """Rules: each of the fields may be missing but not empty."""
    return [(F.coalesce(F.col(f) == "", F.lit(False)), f"empty_{f}") for f in fields]


def _checked(rows: DataFrame, *rules: tuple[Column, str]) -> DataFrame:
    return rows.withColumn("reason", F.coalesce("reason", first_reason(*rules)))


def _entries(docs: DataFrame, kind: str, field: str) -> DataFrame:
    """docs, those that have no entries in an array or map and no reason yet with reason no_<kind>."""
    return docs.withColumn("reason", F.coalesce("reason", F.when(F.coalesce(F.size(F.col(field)), F.lit(0)) < 1, f"no_{kind}")))


def _with_repeats(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds `_twice`: whether the row's key stands in more than one row; null keys never do."""
    twice = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").select(*keys, F.lit(True).alias("_twice"))
    return rows.join(twice, list(keys), "left").withColumn("_twice", F.coalesce("_twice", F.lit(False)))


def attempts(spark: SparkSession, path: str, known: Sequence[str] = ATTEMPT_TAGS) -> DataFrame:
    """The attempt ledger, one JSON object a line; every row of an id that repeats is rejected."""
    rows = _with_repeats(documents(spark, path, ATTEMPT, known, lines=True), ["attempt_id"])
    rules = [(F.col("attempt_id").isNull(), "missing_attempt_id"), (F.col("_twice"), "duplicate_attempt_id"), *required("specification_id", "artifact_state", "isolation")]
    rules += [*optional("measurement_path", "provenance_path", "composite_path", "raw_sha256"), *required("recorded_at")]
    return _checked(rows, *rules).withColumn("ordinal", F.coalesce("ordinal", F.lit(0))).drop("_twice", "stem", "document")


def manifest(spark: SparkSession, path: str, known: Sequence[str] = MANIFEST_TAGS) -> tuple[DataFrame, DataFrame]:
    """Specifications and promotions of manifests, one row for each entry of the two arrays; ids are unique in a file."""
    docs = documents(spark, path, f"schema string, specifications array<{_struct(SPECIFICATION)}>, promotions array<{_struct(PROMOTION)}>", known, lines=True)

    def entries(field: str, rules: list[tuple[Column, str]]) -> DataFrame:
        rows = _entries(docs, field, field).select("document", "reason", F.explode_outer(field).alias("e")).select("document", "reason", "e.*")
        return _checked(_with_repeats(rows, ["document", "id"]), (F.coalesce("id", F.lit("")) == "", "missing_id"), (F.col("_twice"), "duplicate_id"), *rules).drop("_twice")

    specifications = entries("specifications", [*required("motion_class", "target_gate"), *optional("active_promotion")])
    return specifications, entries("promotions", required("specification_id", "attempt_id", "measurement_path", "status", "recorded_at"))


def _number(v: Column) -> Column:
    """A variant's number; null if it is none (a number written as text is none)."""
    return F.when(F.schema_of_variant(v).rlike("^(DECIMAL|DOUBLE|FLOAT|BIGINT|INT)"), F.try_variant_get(v, "$", "double"))


def profiles(spark: SparkSession, path: str, known: Sequence[str] = PROFILE_TAGS) -> DataFrame:
    """Acceptance profiles: class -> gates -> entry, one row for each class and gate; budgets that are no numbers are null."""
    docs = documents(spark, path, f"schema string, profiles map<string, struct<gates: map<string, {_struct(PROFILE)}>>>", known, lines=True)
    rows = _entries(docs, "profiles", "profiles").select("reason", F.explode_outer("profiles").alias("motion_class", "p"))
    rows = _entries(rows, "gates", "p.gates").select("reason", "motion_class", F.explode_outer("p.gates").alias("gate", "e"))
    rows = rows.select("motion_class", "gate", "e.*", "reason").withColumns({c: _number(F.col(c)) for c in ("budget", "hard_fail")})
    return _checked(rows, *required("status"), *optional("active_promotion", "control_attempt", "evidence_attempt"))


def measurements(spark: SparkSession, path: str, known: Sequence[str] = MEASUREMENT_TAGS) -> DataFrame:
    """Measurement runs, one row for each gate (one with a null gate where a run has none); caveats default to none.

    A gate's own reason comes as gate_reason.
    """
    docs = documents(spark, path, MEASUREMENT, known, lines=True)
    docs = _checked(docs, (F.col("raw_sha256").isNull(), "missing_raw_sha256"), *required("motion_class", "target_gate", "isolation"))
    docs = docs.withColumn("caveats", F.coalesce("caveats", F.array().cast("array<string>")))
    return docs.select("*", F.explode_outer("gates").alias("gate", "g")).select(*(c for c in docs.columns if c not in ("gates", "stem", "document")), "gate", *(F.col(f"g.{f.split()[0]}").alias("gate_reason" if f.startswith("reason") else f.split()[0]) for f in GATE.split(", ")))


def provenance(spark: SparkSession, path: str, known: Sequence[str] = PROVENANCE_TAGS) -> DataFrame:
    """Provenance records with all that binds an attempt to its raw file."""
    return _checked(documents(spark, path, PROVENANCE, known, lines=True), *required("raw_sha256", "specification_id", "attempt_id", "raw_path")).drop("stem", "document")


LOCKS = (
    "schema string, motion_classes map<string, struct<"
    "locks: array<struct<id: string, rectangle: struct<x0: int, y0: int, x1: int, y1: int>, permitted_offsets: array<array<int>>, permitted_dx: array<int>, permitted_dy: array<int>,"
    " comparison: string, max_occupancy_difference: double, max_palette_role_distance: double>>,"
    " relational_constraints: array<struct<anchors: array<string>, max_dx_delta: int, max_vertical_separation_delta: int>>,"
    " landmarks: array<struct<id: string, canonical: array<int>, palette_role: string, max_distance: int>>>>"
)


def lock_specs(spark: SparkSession, path: str, known: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Locks with their rectangle, offsets and thresholds in declared order; landmarks; relational limits of two locks.

    A document that can't be used, or a class without locks, has its row and reason among the locks; a class may be
    without landmarks and limits.

    offsets is the list as declared, or the product of permitted_dx and permitted_dy (dx slower than dy).
    """
    docs = _entries(documents(spark, path, LOCKS, known, lines=True), "classes", "motion_classes").select("reason", F.explode_outer("motion_classes").alias("motion_class", "m"))
    head = ["reason", "motion_class"]
    pair = lambda dx, dy: F.struct(dx.alias("dx"), dy.alias("dy"))
    rows = _entries(docs, "locks", "m.locks").select(*head, F.posexplode_outer("m.locks").alias("ord", "l"))
    product = F.flatten(F.transform("l.permitted_dx", lambda x: F.transform("l.permitted_dy", lambda y: pair(x, y))))
    offsets = F.coalesce(F.transform("l.permitted_offsets", lambda o: pair(o[0], o[1])), product)
    locks = rows.select(*head, "ord", "l.id", "l.rectangle.*", offsets.alias("offsets"), "l.comparison", F.col("l.max_occupancy_difference").alias("most_occupancy"), F.col("l.max_palette_role_distance").alias("most_roles"))
    inverted = F.coalesce((F.col("x0") > F.col("x1")) | (F.col("y0") > F.col("y1")), F.lit(True))
    structure = F.col("comparison") == "registered-structure"
    locks = _checked(
        locks, *required("id"), (inverted, "inverted_rectangle"), (F.coalesce(F.size("offsets"), F.lit(0)) < 1, "no_offsets"),
        (F.coalesce(~F.col("comparison").isin("registered-structure", "exact-roles"), F.lit(True)), "unknown_comparison"),
        (structure & (F.col("most_occupancy").isNull() | F.col("most_roles").isNull()), "missing_threshold"),
    )
    marks = docs.select(*head, F.posexplode("m.landmarks").alias("ord", "l")).select(*head, "ord", "l.id", F.get("l.canonical", F.lit(0)).alias("x"), F.get("l.canonical", F.lit(1)).alias("y"), F.col("l.palette_role").alias("role"), F.col("l.max_distance").alias("most"))
    marks = _checked(marks, *required("id", "role"), (F.col("x").isNull() | F.col("y").isNull() | F.coalesce(F.col("most") < 0, F.lit(True)), "bad_landmark"))
    limits = docs.select(*head, F.explode("m.relational_constraints").alias("c")).select(*head, F.get("c.anchors", F.lit(0)).alias("a"), F.get("c.anchors", F.lit(1)).alias("b"), F.col("c.max_dx_delta").alias("most_dx"), F.col("c.max_vertical_separation_delta").alias("most_dy"))
    names = locks.select("motion_class", F.col("id").alias("_id")).distinct()
    for side in ("a", "b"):
        limits = limits.join(names.withColumnRenamed("_id", side).withColumn(f"_{side}", F.lit(True)), ["motion_class", side], "left")
    limits = _checked(limits, (F.col("_a").isNull() | F.col("_b").isNull(), "unknown_anchor")).drop("_a", "_b")
    return locks, marks, limits


def master_palettes(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Palettes as entries in order: palette_id, ord (over the whole palette), role, hex, rgb and reason; usable tells
    whether no entry of the palette has a reason.

    Reasons: unreadable, no_role_groups, missing_role, duplicate_role (every row of the later group), no_colors and
    bad_color (not # and six hexadecimal digits).
    """
    docs = _entries(documents(spark, path, "palette_id string, role_groups array<struct<id: string, colors: array<string>>>", None, lines), "role_groups", "role_groups")
    groups = docs.select(F.coalesce("palette_id", "stem").alias("palette_id"), "document", "reason", F.col("role_groups.id").alias("_ids"), F.posexplode_outer("role_groups").alias("group", "g"))
    role = F.col("g.id")
    again = F.array_contains(F.slice("_ids", 1, F.col("group")), role)
    rules = first_reason(((F.coalesce(role, F.lit("")) == "") & F.col("group").isNotNull(), "missing_role"), (F.coalesce(again, F.lit(False)), "duplicate_role"), (F.col("group").isNotNull() & (F.coalesce(F.size("g.colors"), F.lit(0)) < 1), "no_colors"))
    rows = groups.withColumn("reason", F.coalesce("reason", rules)).select("palette_id", "document", "group", role.alias("role"), "reason", F.posexplode_outer("g.colors").alias("place", "hex"))
    fine = F.coalesce(F.col("hex").rlike("^#[0-9A-Fa-f]{6}$"), F.lit(False))
    rows = _checked(rows, (F.col("place").isNotNull() & ~fine, "bad_color")).withColumn("rgb", F.when(fine, F.conv(F.substring("hex", 2, 6), 16, 10).cast("int")))
    # a palette is one document, of some hundred entries at most
    own = Window.partitionBy("palette_id", "document")
    rows = rows.withColumns({"ord": (F.row_number().over(own.orderBy("group", "place")) - 1).cast("int"), "usable": F.count("reason").over(own) == 0})
    return rows.select("palette_id", "ord", "role", "hex", "rgb", "reason", "usable")


def pack_entries(packs: DataFrame, keys: DataFrame) -> DataFrame:
    """Entries of asset packs with their place and a reason.

    packs: pack_id and entries, an array of struct(id, kind, animation, facing, frames array of file keys); keys: pack_id
    and key, the files that are there. An animation gives a row for each frame, a static entry one row. A frame that
    ends in * stands for all keys it is a prefix of, in order of their names. Reasons: unknown_kind, duplicate_id,
    unknown_facing, empty_prefix (no key begins so), unknown_key.
    """
    rows = packs.select("pack_id", F.posexplode("entries").alias("entry", "e")).select("pack_id", "entry", "e.*")
    rows = _with_repeats(rows, ["pack_id", "id"]).select("*", F.posexplode("frames").alias("place", "wanted"))
    prefix = F.when(F.col("wanted").endswith("*"), F.expr("left(wanted, length(wanted) - 1)"))
    rows = rows.withColumn("prefix", prefix)
    # exact keys by name; prefixes by name of their first characters, so that this is an equi-join, too
    exact = rows.filter("prefix is null").join(keys.withColumnRenamed("key", "wanted").withColumn("key", F.col("wanted")), ["pack_id", "wanted"], "left")
    listed = rows.filter("prefix is not null").join(keys, (rows["pack_id"] == keys["pack_id"]) & keys["key"].startswith(rows["prefix"]), "left").drop(keys["pack_id"])
    both = exact.select(*rows.columns, "key").unionByName(listed.select(*rows.columns, "key"))
    reason = first_reason(
        (F.coalesce(~F.col("kind").isin("animation", "static"), F.lit(True)), "unknown_kind"), (F.col("_twice"), "duplicate_id"),
        ((F.col("kind") == "animation") & F.coalesce(~F.col("facing").isin("left", "right", "both"), F.lit(True)), "unknown_facing"),
        (F.col("prefix").isNotNull() & F.col("key").isNull(), "empty_prefix"), (F.col("key").isNull(), "unknown_key"),
    )
    return both.select("pack_id", "entry", "id", "kind", "place", "wanted", "key", reason.alias("reason"))
