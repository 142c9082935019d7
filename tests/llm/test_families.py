"""Near duplicates in large buckets: families of texts that share most of their words."""

import random

from framegauge.llm import near_dup


def _components(rows):
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def _got(spark, rows):
    return {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_blocks_of_a_bucket_find_what_brute_force_finds(spark, monkeypatch):
    """Texts of one template, filled in from few phrases, so that no shingle is alone; buckets of many blocks."""
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 4)
    rng = random.Random(11)
    template = [f"t{k}" for k in range(44)]
    phrases = [" ".join(f"p{k}x{j}" for j in range(8)) for k in range(14)]
    rows = [(i, " ".join([*template, *(rng.choice(phrases) for _ in range(4))])) for i in range(120)]
    want = _components(rows)
    assert _got(spark, rows) == want and 1 < len(set(want.values())) < 120


def test_a_family_with_own_words_is_compared_with_no_pair(spark, monkeypatch):
    """Texts at similarity 0.56 that each have words of their own: none of their pairs reaches the join."""
    rng = random.Random(12)
    template = [f"t{k}" for k in range(80)]
    rows = [(i, " ".join([*template, *(f"o{rng.randrange(10**9)}" for _ in range(30))])) for i in range(1500)]
    rows += [(5000, rows[3][1] + " more"), (5001, rows[3][1] + " other")]
    made = []
    real = near_dup.cut
    monkeypatch.setattr(near_dup, "cut", lambda df, name: made.append((name, real(df, name))) or made[-1][1])
    got = _got(spark, rows)
    assert {i: c for i, c in got.items() if i != c} == {5000: 3, 5001: 3}
    in_join = [df for name, df in made if name == "mixed"][-1]
    assert in_join.select("rep").distinct().count() <= 3
