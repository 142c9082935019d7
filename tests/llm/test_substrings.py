"""Repeated passages: texts with one key, and anchors that stand nearly everywhere."""

import random

import pytest
from pyspark.sql import functions as F

from framegauge.llm import substring_dedup


def _brute(rows):
    lists = [(t or "").split() for _, t in rows]
    counts = {}
    for w in lists:
        for k in range(len(w) - 34):
            counts[tuple(w[k : k + 35])] = counts.get(tuple(w[k : k + 35]), 0) + 1
    out = []
    for (i, _), w in zip(rows, lists, strict=True):
        gone = set()
        for k in range(len(w) - 34):
            if counts[tuple(w[k : k + 35])] > 1:
                gone |= set(range(k, k + 35))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def _got(spark, rows, **options):
    out = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), **options)
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out.collect())


@pytest.fixture(scope="module")
def rows():
    """Documents around one very common phrase, with passages that recur in pairs, in many and in long runs."""
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(10**6)}"
    common = [f"c{k}" for k in range(30)]
    shared = [[word() for _ in range(n)] for n in (40, 90, 700)]
    out = []
    for i in range(60):
        parts = [[word() for _ in range(rng.randrange(5, 60))], common, [word() for _ in range(20)], rng.choice(shared), common, [word() for _ in range(9)]]
        out.append((i, " ".join(w for p in parts for w in p)))
    return [*out, (60, out[0][1]), (61, out[0][1]), (62, None), (63, "")]


def test_texts_with_one_key_stay_apart(spark, rows, monkeypatch):
    first, second = rows[3][1], rows[4][1]
    monkeypatch.setattr(substring_dedup, "text_key", lambda t: F.when(t.isin(first, second), F.lit(7).cast("long")).otherwise(F.xxhash64(t)))
    assert _got(spark, rows) == _brute(rows)


@pytest.mark.parametrize("most", [0, 5, 70])
def test_hot_anchors_give_the_same_rows(spark, rows, most):
    assert _got(spark, rows, shard_bytes=4000, hot_anchor=most) == _brute(rows)
