"""Every rule of the evidence walk on a sound graph with one thing changed, and the registration rules."""

from framegauge.operators import graph as G

TABLES = {
    "specifications": ("id string, motion_class string, target_gate string, active_promotion string", [("s1", "walk", "loop", "p1"), ("s2", "idle", "loop", None)]),
    "promotions": ("id string, specification_id string, attempt_id string, measurement_path string, status string", [("p1", "s1", "a1", "m1", "ACTIVE")]),
    "attempts": ("attempt_id string, specification_id string, artifact_state string, measurement_path string, provenance_path string, raw_sha256 string", [("a1", "s1", "retained", "m1", "v1", "h1"), ("a2", "s2", "retained", "m2", "v2", "h2"), ("a3", "s2", "discarded", "", "v9", None)]),
    "measurements": ("path string, motion_class string, target_gate string, raw_sha256 string", [("m1", "walk", "loop", "h1"), ("m2", "idle", "loop", "h2")]),
    "provenances": ("path string, attempt_id string, specification_id string, raw_path string, raw_sha256 string", [("v1", "a1", "s1", "r1", "h1"), ("v2", "a2", "s2", "r2", "h2")]),
    "files": ("path string, actual string", [("r1", "h1"), ("r2", "h2")]),
}


LINKS = {"id", "active_promotion", "specification_id", "attempt_id", "measurement_path", "path", "provenance_path", "raw_path"}


def _worlds(spark, cases, focus=None):
    """Many changed graphs in one, their ids and paths apart. changes: {table: [(row, column, value)]}; column None takes
    the row away, or adds it once more if value is set. Gives the faults of each case."""
    frames = []
    for name, (schema, table) in TABLES.items():
        columns, every = [c.split()[0] for c in schema.split(", ")], []
        for k, changes in enumerate(cases):
            rows = [list(r) for r in table]
            for row, column, value in changes.get(name, []):
                if column is None:
                    rows = rows + [rows[row]] if value else rows[:row] + rows[row + 1 :]
                else:
                    rows[row][column] = value
            every += [[f"{k}/{v}" if c in LINKS and v else v for c, v in zip(columns, r, strict=True)] for r in rows]
        frames.append(spark.createDataFrame(every, schema))
    focus = focus and spark.createDataFrame([(f"{k}/{x}",) for k in range(len(cases)) for x in focus], "id string")
    out = [set() for _ in cases]
    for r in G.check_graph(*frames, focus=focus).collect():
        k, ident = r.id.split("/")
        if r.reason:
            out[int(k)].add((r.kind, ident, r.hop, r.reason))
    return out


def test_a_sound_graph_has_a_row_for_each_record(spark):
    frames = [spark.createDataFrame(rows, schema) for schema, rows in TABLES.values()]
    assert {(r.kind, r.id, r.reason) for r in G.check_graph(*frames).collect()} == {("specification", "s1", None), ("specification", "s2", None), ("promotion", "p1", None), ("attempt", "a2", None), ("attempt", "a3", None)}


P, A = "promotion", "attempt"


CASES = [
    ({"promotions": [(0, None, None)]}, ("specification", "s1", P, "broken_reference")),
    ({"promotions": [(0, 1, "s2")]}, ("specification", "s1", P, "identity_specification")),
    ({"promotions": [(0, 2, "a9")]}, (P, "p1", A, "missing_attempt")),
    ({"promotions": [(0, 1, "s9")]}, (P, "p1", "specification", "broken_reference")),
    ({"promotions": [(0, 1, "s2")]}, (P, "p1", A, "identity_specification")),
    ({"attempts": [(0, 2, "discarded")]}, (P, "p1", A, "discarded_candidate")),
    ({"promotions": [(0, 3, "m9")]}, (P, "p1", "measurement", "missing_file")),
    ({"measurements": [(0, 2, "drift")]}, (P, "p1", "measurement", "identity_gate")),
    ({"measurements": [(0, 1, "idle")]}, (P, "p1", "measurement", "identity_class")),
    ({"attempts": [(0, 4, None)]}, (P, "p1", "provenance", "unnamed_file")),
    ({"provenances": [(0, None, None)]}, (P, "p1", "provenance", "missing_file")),
    ({"provenances": [(0, 1, "a2")]}, (P, "p1", "provenance", "identity_attempt")),
    ({"provenances": [(0, 2, None)]}, (P, "p1", "provenance", "identity_specification")),
    ({"files": [(0, None, None)]}, (P, "p1", "raw", "missing_file")),
    ({"files": [(0, 1, "x")]}, (P, "p1", "provenance", "hash_mismatch")),
    ({"provenances": [(0, 4, None)]}, (P, "p1", "provenance", "missing_hash")),
    ({"measurements": [(0, 3, "x")]}, (P, "p1", "measurement", "hash_mismatch")),
    ({"measurements": [(0, 3, None)]}, (P, "p1", "measurement", "missing_hash")),
    ({"attempts": [(0, 5, "x")]}, (P, "p1", A, "hash_mismatch")),
    ({"attempts": [(0, 5, None)]}, (P, "p1", A, "missing_hash")),
    ({"attempts": [(0, None, True)]}, (P, "p1", A, "ambiguous")),
    ({"measurements": [(1, None, None)]}, (A, "a2", "measurement", "missing_file")),
    ({"measurements": [(1, 3, "x")]}, (A, "a2", "measurement", "hash_mismatch")),
    ({"provenances": [(1, None, None)]}, (A, "a2", "provenance", "missing_file")),
    ({"provenances": [(1, 4, "x")]}, (A, "a2", "provenance", "hash_mismatch")),
    ({"attempts": [(1, 5, "x")]}, (A, "a2", A, "hash_mismatch")),
    ({"attempts": [(1, None, True)]}, (A, "a2", A, "ambiguous")),
    ({"files": [(1, None, None)]}, None), ({"attempts": [(1, 5, None)]}, None), ({"provenances": [(1, 1, "a9")]}, None),
]


def test_one_fault_one_reason(spark):
    also = {("specification", "s1", P, "identity_specification"), (P, "p1", A, "identity_specification"), ("specification", "s1", P, "broken_reference"), (P, "p1", "specification", "broken_reference")}
    for (changes, want), found in zip(CASES, _worlds(spark, [c for c, _ in CASES]), strict=True):
        assert (want in found if want else not found) and {f for f in found if f != want} <= also, (changes, found)


def test_focus_is_deep_for_named_promotions_only(spark):
    broken = {"measurements": [(0, 3, "x"), (1, None, None)]}
    assert _worlds(spark, [broken], ["p1"]) == [{(P, "p1", "measurement", "hash_mismatch")}]
    # without a focus on it the promotion's attempt is history: its digests are compared where the file exists
    assert _worlds(spark, [broken], ["p7"]) == [{(P, "p7", P, "unknown_promotion"), (A, "a1", "measurement", "hash_mismatch")}]


def test_profiles(spark):
    spec, proms = (spark.createDataFrame(TABLES[n][1], TABLES[n][0]) for n in ("specifications", "promotions"))
    rows = [("walk", "loop", "SEPARATED", "p1"), ("idle", "loop", "SEPARATED", "p1"), ("idle", "drift", "SEPARATED", "p1"), ("walk", "drift", "SEPARATED", "p9"), ("run", "loop", "UNSEPARATED", "p9"), ("run", "drift", "SEPARATED", None)]
    profiles = spark.createDataFrame(rows, "motion_class string, gate string, status string, active_promotion string")
    got = {r.id: r.reason for r in G.check_profiles(profiles, spec, proms).collect()}
    assert got == {"walk/loop": None, "idle/loop": "alternate_promotion", "idle/drift": "missing_specification", "walk/drift": "missing_promotion"}
    pending = spark.createDataFrame([("p1", "s1", "a1", "m1", "PENDING_VERIFICATION")], TABLES["promotions"][0])
    assert {r.reason for r in G.check_profiles(profiles.limit(1), spec, pending).collect()} == {"not_active"}


def test_registration(spark):
    kind = "struct<generation_mode:string,motion_class:string,prompt_sha256:string>"
    store = spark.createDataFrame([
        ("a1", 1, "h1", "open", ("new", "walk", None)), ("a1", 9, "h9", "rejected", None), ("a2", 2, "h2", "rejected", ("new", "walk", "q")), ("a3", 3, "h3", "open", None), ("a4", 4, "h4", "open", ("new", "walk", "q")), ("a5", 5, "h4", "open", ("new", "walk", "q"))],
        f"attempt_id string, place int, raw_sha256 string, outcome string, provenance {kind}")
    claims = [("a1", "h1", "new", "walk", None, None), ("a9", "h1", "new", "walk", None, "not_in_store"), ("a1", "h9", "new", "walk", None, "digest_differs"), ("a2", "h2", "new", "walk", "q", "rejected"), ("a3", "h3", "new", "walk", "q", "no_provenance"),
              ("a4", "h4", "new", "walk", "q", "not_the_last"), ("a5", "h4", "new", "walk", "q", None), ("a5", "h4", "edit", "walk", "q", "generation_mode_differs"), ("a5", "h4", "new", None, "q", "motion_class_differs"), ("a5", "h4", "new", "walk", "", "prompt_sha256_differs"), (None, "h4", "new", "walk", "q", "not_in_store")]
    df = spark.createDataFrame(claims, "attempt_id string, provider_sha256 string, generation_mode string, motion_class string, prompt_sha256 string, want string")
    rows = G.check_registration(df, store).collect()
    assert len(rows) == len(claims) and all(r.reason == r.want for r in rows), rows
