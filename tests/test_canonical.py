"""Canonical JSON and configuration digests against Python's own serialiser."""

import hashlib
import json

from pyspark.sql import functions as F

from framegauge.functions.canonical import canonical_json
from framegauge.operators.controls import config_digests


def _dump(value):
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def test_nested_values_equal_python(spark):
    schema = "z int, a struct<y:string,b:array<double>,m:map<string,struct<q:boolean,p:bigint>>>, empty map<string,int>"
    rows = [
        (1, {"y": 'quote " back \\ slash / tab \t é ☃ 😀 \u0001', "b": [0.5, None, 0.0001, 123.0, -2.25, 0.0], "m": {"b": {"q": True, "p": 1 << 40}, "a": {"q": None, "p": None}, "é": None}}, {}),
        (None, None, None), (0, {"y": "", "b": [], "m": {"b": None}}, {"2": 2, "10": None}),
    ]
    df = spark.createDataFrame(rows, schema)
    value = F.struct("z", "a", "empty")
    got = [r[0] for r in df.select(canonical_json(value, df.select(value.alias("v")).schema["v"].dataType)).collect()]
    want = [_dump(dict(zip(("z", "a", "empty"), r, strict=True))) for r in rows]
    assert got == want


def test_config_digests_equal_python(spark):
    profiles = [("c", "walk", "loop", "SEPARATED", 0.4136, 0.4294, "p1"), ("c", "walk", "drift", "UNSEPARATED", 0.3, None, None), ("c", "idle", "loop", "INAPPLICABLE", None, None, None), ("d", "walk", "loop", "SEPARATED", 0.1, 0.2, None), ("e", "walk", "loop", "SEPARATED", 0.1, 0.2, None), ("e", "walk", "loop", "SEPARATED", 0.1, 0.3, None), ("f", "walk", "loop", "SEPARATED", 0.1, 0.2, "p9")]
    promotions = [("c", "p2", "s2", "a2", "m2", "ACTIVE"), ("c", "p1", "s1", "a1", "m1", "ACTIVE"), ("c", "p3", "s3", "a3", "m9", "INVALIDATED"), ("f", "p9", "s", "a", "m9", "ACTIVE")]
    tables = [spark.createDataFrame(profiles, "config_id string, motion_class string, gate string, status string, budget double, hard_fail double, active_promotion string"), spark.createDataFrame(promotions, "config_id string, id string, specification_id string, attempt_id string, measurement_path string, status string"), spark.createDataFrame([("m1", "h1"), ("m2", "h2")], "path string, raw_sha256 string")]
    policy = {"rounding": "ceiling", "places": 4, "by": None}
    got = {r.config_id: (r.digest, r.reason) for r in config_digests(*(t.repartition(3) for t in tables), policy).collect()}

    def digest(config, active):
        payload = {"acceptance_profiles": {}, "active_promotions": active, "numeric_policy": policy}
        for c, k, g, *rest in profiles:
            if c == config:
                payload["acceptance_profiles"].setdefault(k, {})[g] = dict(zip(("status", "budget", "hard_fail", "active_promotion"), rest, strict=True))
        return hashlib.sha256(_dump(payload).encode()).hexdigest()[:16]

    rows = [{"id": f"p{i}", "specification_id": f"s{i}", "attempt_id": f"a{i}", "measurement_raw_sha256": f"h{i}"} for i in (1, 2)]
    assert got == {"c": (digest("c", rows), None), "d": (digest("d", []), None), "e": (None, "duplicate_gate"), "f": (None, "missing_measurement")}
