"""The learned queries against plain Python and NumPy, and odd rows of every operator."""

import zlib
from collections import Counter

import numpy as np
import pytest

from framegauge.llm import ann, decontam, language, near_dup, quality, queries, substring_dedup, toxicity


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    return docs, labels


def _fold(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


def _counts(text):
    b = (text or "").encode()
    w = b.split()
    marks, loud = set(b".,;:'\"-()"), set(b"!?")
    symbols = {*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)} - marks - loud
    upper, lower = sum(65 <= c <= 90 for c in b), sum(97 <= c <= 122 for c in b)
    triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    return {
        "word_size": sum(map(len, w)), "upper": upper, "digits": sum(48 <= c <= 57 for c in b), "symbols": sum(c in symbols for c in b), "loud": sum(c in loud for c in b),
        "marks": sum(c in marks for c in b), "wide": sum(c >= 128 for c in b), "lines": b.count(b"\n"), "again": len(w) - len(set(w)), "top_word": max(Counter(w).values(), default=1) - 1,
        "same_next": sum(x == y for x, y in zip(w, w[1:], strict=False)), "triples_again": len(triples) - len(set(triples)), "symbol_ends": sum(x[-1] in symbols | loud for x in w),
        "short_words": sum(len(x) <= 2 for x in w), "size": len(b), "letters": upper + lower, "words": len(w),
    }


def test_quality_query_equals_plain_arithmetic(spark, sf_dir, tables):
    docs, labels = tables
    counts = {i: _counts(t) for i, t, _ in docs}
    total = Counter()
    for c in counts.values():
        total.update(c)
    def statistics(c):
        x = [(c[n] + quality.PRIOR[s] * total[n] / total[s]) / (c[s] + quality.PRIOR[s]) for n, s in quality.STATISTICS.items()]
        return np.array([np.log1p(x[0]), *np.sqrt(x[1:])])
    rows = {k: np.array([statistics(counts[i]) for i, _, _ in docs if i in labels and labels[i].quality == k and _fold(i, 3) != 1]) for k in (0, 1)}
    both = np.concatenate([rows[0], rows[1]])
    shift, scale = both.mean(axis=0), both.std(axis=0)
    scale[scale < 1e-5] = 1
    z = {k: (r - shift) / scale for k, r in rows.items()}
    own = {k: np.cov(r.T, bias=True) for k, r in z.items()}
    pooled = (len(z[0]) * own[0] + len(z[1]) * own[1]) / len(both)
    a, p = quality.TO_DIAGONAL, quality.TO_POOLED
    shrunk = {k: (1 - a - p) * s + a * np.diag(np.diag(s)) + p * pooled + quality.RIDGE * np.eye(len(s)) for k, s in own.items()}
    def density(k, x):
        d = x - z[k].mean(axis=0)
        return np.log(len(z[k])) - 0.5 * (d @ np.linalg.solve(shrunk[k], d) + np.linalg.slogdet(shrunk[k])[1])
    got = {r.doc_id: r for r in queries.op7_quality(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for i, _, _ in docs:
        x = (statistics(counts[i]) - shift) / scale
        want = 1 / (1 + np.exp(-np.clip(density(1, x) - density(0, x), -60, 60)))
        assert abs(got[i].score - want) < 1e-6 and got[i].predicted == int(got[i].score >= 0.5) and got[i].held_out == (_fold(i, 3) == 1), i


def _hypervector(text):
    spaced = " ".join("".join(c if c.isalpha() else " " for c in text or "").split())
    letters = [ord(c.lower()[0]) if c != " " else 0 for c in f" {spaced} "] if spaced else []
    v = {c: language._letter_vector(c).astype(float) for c in set(letters)}
    triples = Counter(zip(letters, letters[1:], letters[2:], strict=False))
    return sum((n * np.roll(v[a], 2) * np.roll(v[b], 1) * v[c] for (a, b, c), n in triples.items()), np.zeros(language.DIMENSIONS))


def test_language_query_equals_plain_arithmetic(spark, sf_dir, tables):
    docs, _ = tables
    vectors = {i: _hypervector(t) for i, t, _ in docs}
    unit = lambda x: x / max(np.linalg.norm(x), 1e-12)
    langs = sorted({g for i, t, g in docs if g and t is not None and _fold(i, 4) != 2})
    raw = [unit(sum(unit(vectors[i]) for i, t, g in docs if g == lang and t is not None and _fold(i, 4) != 2)) for lang in langs]
    prototypes = [unit(x - np.mean(raw, axis=0)) for x in raw]
    got = {r.doc_id: r for r in queries.op8_language(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for i, _, _ in docs:
        cos = [float(unit(vectors[i]) @ p) for p in prototypes]
        best = int(np.argmax(cos))
        some = np.abs(vectors[i]).sum() > 0
        assert got[i].lang_pred == (langs[best] if some else "und") or abs(sorted(cos)[-1] - sorted(cos)[-2]) < 1e-4, i
        assert abs(got[i].score - (min(max(cos[best], 0), 1) if some else 0)) < 1e-4 and got[i].held_out == (_fold(i, 4) == 2)


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row


def test_toxicity_query_equals_plain_python(spark, sf_dir, tables):
    docs, labels = tables
    learned = [(labels[i].toxic, t) for i, t, _ in docs if i in labels and labels[i].toxic in (0, 1) and _fold(i, 3) != 1]
    assert len(learned) < toxicity.LEARN_ROWS
    rate = np.log(sum(y for y, _ in learned) / len(learned))
    held: dict[str, list[int]] = {}
    for y, t in learned:
        words = {w for x in set((t or "").lower().split()) if 2 < len(w := toxicity.bare(x)) < 40 and not w.isdigit()}
        for term in {f"{w} " for w in words} | {w[:k] for w in words for k in toxicity.STEMS if len(w) >= k}:
            held.setdefault(term, [0, 0])[y] += 1
    good = sorted(((n1, len(t), t) for t, (n0, n1) in held.items() if (n1 - 8 * n0) * rate < toxicity.CHANCE), key=lambda x: (-x[0], -x[1], x[2]))
    chosen: list[tuple[str, int]] = []
    for n, _, term in good:
        word = term.rstrip(" ")
        if any(k < len(term) and any(c == word[:k] for c, _ in chosen) for k in toxicity.STEMS) or any(c.startswith(word) and n < 1.1 * m for c, m in chosen):
            continue
        chosen.append((term, n))
    n1, n0 = (sum(y == k for y, _ in learned) for k in (1, 0))
    insults = [w + end for w in toxicity.INSULTS for end in ("", "s")]
    counts = {w: held.get(f"{w} ", [0, 0]) for w in insults}
    terms = {w: False for w, (c0, c1) in counts.items() if c0 * n1 * 4 <= c1 * n0}
    for term, _ in chosen:
        terms[term.rstrip(" ")] = not term.endswith(" ") or terms.get(term.rstrip(" "), False)
    assert terms == toxicity.learn_lexicon(spark.createDataFrame(learned, "label int, text string").repartition(37))
    kinds: dict[str, int] = {}
    runs = lambda w: "".join(c for i, c in enumerate(w) if not i or w[i - 1] != c)

    def edited(word):
        if word not in kinds:
            w, best = toxicity.bare(word), 0
            for t, stem in terms.items():
                if not w or best == 1 or (not stem and abs(len(w) - len(t)) > 2):
                    continue
                row = _distance(t, w[: len(t) + 3])
                least = min(row) if stem else _distance(t, w)[-1]
                best = 1 if least == 0 else max(best, 2) if least <= toxicity.edits_allowed(t) else best
            kinds[word] = best
        return kinds[word]

    use: dict[str, list[int]] = {}
    for y, t in learned:
        for w in {toxicity.bare(x) for x in set((t or "").lower().split()) if edited(x) == 2}:
            use.setdefault(w, [0, 0])[y] += 1
    ordinary = {w for w, (c0, c1) in use.items() if c0 and c1 < 8 * c0}

    def kind(word):
        w, k = toxicity.bare(word), edited(word)
        if k < 2 or w in ordinary:
            return k % 2
        same = runs(w) != w and any(runs(w).startswith(runs(t)) if stem else runs(w) == runs(t) for t, stem in terms.items())
        return 2 if same or word[0] in "@$" or any(not c.isalpha() and c not in "'’-" for c in w) else 3

    class Plain:
        def hits(self, words):
            return {w: k for w in words if (k := kind(w))}

    x = {i: toxicity.features(Plain(), t) for i, t, _ in docs}
    ids = [i for i, t, _ in docs if i in labels and labels[i].toxic in (0, 1) and _fold(i, 3) != 1]
    weights = toxicity.fit_weights(np.array([x[i] for i in ids]), np.array([labels[i].toxic for i in ids], float))
    got = {r.doc_id: r for r in queries.op10_toxicity(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for i, _, _ in docs:
        want = 1 / (1 + np.exp(-np.clip(np.array(x[i]) @ weights[:-1] + weights[-1], -30, 30)))
        assert abs(got[i].score - want) < 1e-6 and got[i].predicted == int(got[i].score >= 0.7) and got[i].held_out == (_fold(i, 3) == 1), i


LONG = "plain words of a long text " * 60_000


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, repeated and very long texts, a null id, and columns named like those of results."""
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "some text"), (4, "some text"), (5, LONG), (None, "id is null"), (6, "ßé ﷽ 12 \x00 x")]
    names = "score double, label int, rep long, key long, h1 long, block int, n int, lang string, hash long, pos int, toxic int, quality int, parts int, component_id string, kept_text string, _id int"
    return spark.createDataFrame([(*r, *([None] * 16)) for r in rows], f"doc_id long, text string, {names}")


def test_odd_rows_of_quality_language_and_toxicity(spark, odd):
    labels = spark.createDataFrame([(4, 1, 1, "x"), (5, 0, 0, "x"), (2, 0, 0, "x"), (None, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    counts = quality.text_counts(odd)
    scored = quality.score_quality(counts, quality.fit_discriminant(counts, labels, "quality")).collect()
    assert len(scored) == 8 and all(0 <= r.score <= 1 for r in scored)
    same = [r.score for r in scored if r.doc_id == 4]
    assert same[0] == same[1]
    learned = language.learn_profiles(odd.withColumn("lang", odd.text.substr(1, 1)))
    predicted = {(str(r.doc_id), r.lang_pred == "und", r.score == 0) for r in language.predict_language(odd, *learned).collect()}
    assert {("1", True, True), ("2", True, True), ("3", True, True)} <= predicted and len(predicted) == 7
    model = toxicity.learn_toxicity(odd, labels)
    scores = toxicity.score_toxicity(odd, model).collect()
    assert len(scores) == 8 and len({r.score for r in scores if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.score_toxicity(odd.limit(0), model).count() == 0


def test_learning_toxicity_does_not_depend_on_partitions(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    models = [toxicity.learn_toxicity(docs.repartition(n), labels) for n in (1, 4, 400)]
    assert models[0].terms == models[1].terms == models[2].terms
    assert np.allclose(models[0].weights, models[1].weights) and np.allclose(models[0].weights, models[2].weights)


def test_odd_rows_of_pairs_passages_and_leaks(spark, odd):
    near = {(str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_dup.near_duplicates(odd).collect()}
    assert {("1", 0, "1", True), ("2", 0, "2", True), ("3", 0, "3", True), ("4", 1, "4", True), ("None", 1, "None", True)} <= near
    left = substring_dedup.remove_repeats(odd).collect()
    assert len(left) == 8 and [r.kept_text for r in left if r.doc_id == 1] == [""] and [r.n_removed for r in left if r.doc_id == 5] == [360_000]
    items = spark.createDataFrame([(1, "plain words of a long text plain words of a long text", 0), (2, None, 0), (2, "", 0), (3, "some text", 0), (3, "some text", 0)], "item_id long, text string, hash int")
    assert sorted((str(r.doc_id), r.item_id) for r in decontam.contaminated(odd, items).collect()) == [("4", 3), ("5", 1)]
    assert decontam.contaminated(odd.limit(0), items).count() == 0 and decontam.contaminated(odd, items.limit(0)).count() == 0


def test_every_item_quoted_in_a_sentence_is_found(spark):
    rng = np.random.Generator(np.random.PCG64(6))
    def item():
        words = ["Add", "the", "of", "Alice", "Bob", "12", "3.5", "km", "+", "=", "9", "and", "so", "Paris", "7", "min", "cost", "x"]
        return " ".join(words[k] for k in rng.integers(0, len(words), rng.integers(9, 30))) + f" u{rng.integers(10**9)} end"
    items = [item() for _ in range(40)] + ["Solve 12 + 30 - 7 * 5 / 2 = 9 now"]
    docs = [(i, f"The page said {t} and went on.") for i, t in enumerate(items)]
    found = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert {(i, i) for i in range(len(items))} <= {(r.doc_id, r.item_id) for r in found.collect()}


def test_odd_rows_of_vectors(spark):
    rows = [(0, [1.0, 0.0], "a", 1), (1, [0.0, 1.0], "a", 1), (1, [0.5, 0.5], "b", 2), (2, [0.0, -1.0], "c", 3), (3, [], "d", 4), (4, [1.0, float("inf")], "e", 5), (200, [1.0, 0.0], "f", 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, part string, score int")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.nearest(frame).collect())
    # equal distances go to the smaller id, and a repeated id counts with its nearer vector
    assert got == [(0, 1, 200), (0, 2, 1), (0, 3, 2), (200, 1, 0), (200, 2, 1), (200, 3, 2)]
