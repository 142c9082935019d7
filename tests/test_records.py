"""Documents of many entries that can't be used have a row with their reason."""

import json
import tempfile

import pytest

from framegauge.sources import records


@pytest.fixture
def write():
    def to(*docs):
        folder = tempfile.mkdtemp(prefix="records-")
        with open(f"{folder}/all.json", "w") as f:
            f.write("\n".join(d if isinstance(d, str) else json.dumps(d) for d in docs))
        return "file://" + folder
    return to


def test_manifests_that_cannot_be_used(spark, write):
    good = {"schema": records.MANIFEST_TAGS[0], "specifications": [{"id": "s", "motion_class": "walk", "target_gate": "g"}], "promotions": []}
    path = write(good, '{"schema": "gate-', {"schema": "other/1", "specifications": [], "promotions": []}, {"specifications": []}, {"schema": records.MANIFEST_TAGS[0]})
    specifications, promotions = records.manifest(spark, path)
    assert sorted((str(r.id), str(r.reason)) for r in specifications.collect()) == [("None", "missing_schema"), ("None", "no_specifications"), ("None", "unknown_schema"), ("None", "unreadable"), ("s", "None")]
    assert sorted(r.reason for r in promotions.collect()) == ["missing_schema", "no_promotions", "no_promotions", "unknown_schema", "unreadable"]


def test_profiles_that_cannot_be_used(spark, write):
    gate = {"status": "SEPARATED", "budget": 0.5}
    tag = records.PROFILE_TAGS[0]
    path = write({"schema": tag, "profiles": {"walk": {"gates": {"loop": gate}}, "idle": {"gates": {}}, "run": {}}}, "[", {"schema": "x", "profiles": {"walk": {"gates": {"loop": gate}}}}, {"schema": tag, "profiles": {}}, {"schema": tag})
    got = sorted((str(r.motion_class), str(r.gate), str(r.reason)) for r in records.profiles(spark, path).collect())
    assert got == [("None", "None", "no_profiles"), ("None", "None", "no_profiles"), ("None", "None", "unreadable"), ("idle", "None", "no_gates"), ("run", "None", "no_gates"), ("walk", "loop", "None"), ("walk", "loop", "unknown_schema")]


def test_locks_that_cannot_be_used(spark, write):
    lock = {"id": "head", "rectangle": {"x0": 1, "y0": 1, "x1": 2, "y1": 2}, "permitted_offsets": [[0, 0]], "comparison": "exact-roles"}
    path = write({"schema": "locks/1", "motion_classes": {"walk": {"locks": [lock]}, "idle": {"locks": []}}}, "{", {"schema": "locks/9", "motion_classes": {}}, {"schema": "locks/1"})
    locks, marks, limits = records.lock_specs(spark, path, ["locks/1"])
    assert sorted((str(r.motion_class), str(r.id), str(r.reason)) for r in locks.collect()) == [("None", "None", "no_classes"), ("None", "None", "unknown_schema"), ("None", "None", "unreadable"), ("idle", "None", "no_locks"), ("walk", "head", "None")]
    assert marks.count() == limits.count() == 0


def test_palettes_keep_their_faulty_entries(spark, write):
    good = {"palette_id": "a", "role_groups": [{"id": "skin", "colors": ["#102030", "#FFffFF"]}, {"id": "cloth", "colors": ["#000000"]}]}
    bad = {"palette_id": "b", "role_groups": [{"id": "skin", "colors": ["#10203", "102030", "#10203G"]}, {"id": "skin", "colors": ["#000001"]}, {"id": "", "colors": ["#000002"]}, {"id": "sky", "colors": []}, {"colors": ["#000003"]}]}
    rows = records.master_palettes(spark, write(good, bad, {"palette_id": "c"}, {"palette_id": "d", "role_groups": []})).orderBy("palette_id", "ord").collect()
    assert [(r.ord, r.role, r.rgb, r.usable) for r in rows if r.palette_id == "a"] == [(0, "skin", 0x102030, True), (1, "skin", 0xFFFFFF, True), (2, "cloth", 0, True)]
    assert [r.reason for r in rows if r.palette_id == "b"] == ["bad_color"] * 3 + ["duplicate_role", "missing_role", "no_colors", "missing_role"]
    assert [(r.palette_id, r.reason, r.usable) for r in rows if r.palette_id in "cd"] == [("c", "no_role_groups", False), ("d", "no_role_groups", False)]


def test_roles_decide_and_ties_go_to_the_darker_colour(spark):
    from framegauge.operators import grid

    # red 32 is as far from 64 (first in order) as from 0; 0x00_00_40 and 0x00_40_00 are as far, blue being darker
    palette = spark.createDataFrame([(0, "a", 0x400000), (1, "a", 0x000000), (2, "b", 0x004000), (3, "b", 0x000040), (4, "c", 0x200000)], "ord int, role string, rgb int")
    cells = spark.createDataFrame([(0, 0x200000, "a"), (1, 0x000000, "b"), (2, 0x200000, None), (3, 0x200000, "sky"), (4, 0xFFFFFF, "a")], "x int, rgb int, role string")
    once = grid.quantise_in_roles(cells, palette)
    assert {r.x: (r.rgb, r.reason) for r in once.collect()} == {0: (0, None), 1: (0x000040, None), 2: (None, "missing_role"), 3: (None, "unknown_role"), 4: (0x400000, None)}
    twice = grid.quantise_in_roles(once.drop("reason").filter("rgb is not null"), palette)
    assert {r.x: r.rgb for r in twice.collect()} == {0: 0, 1: 0x000040, 4: 0x400000}
    assert {r.x: r.role for r in cells.drop("role").join(grid.nearest_entry(cells, palette), "rgb").collect()} == {0: "c", 1: "a", 2: "c", 3: "c", 4: "a"}
