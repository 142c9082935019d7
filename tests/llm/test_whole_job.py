"""Whole-job tests: one for each place where an operator once did less than its docstring says."""

import random

import numpy as np

from framegauge.llm import ann, decontam, toxicity


def test_clean_counts_do_not_depend_on_partitions(spark):
    rows = [(1, f"filler{i} ordinary") for i in range(3)] + [(0, "filler3 ordinary")] + [(0, f"filler{i}") for i in range(4, 100)]
    frame = spark.createDataFrame(rows, "label int, text string")
    one, many = (toxicity.learn_lexicon(frame.repartition(n)) for n in (1, 100))
    assert one == many and not any(t.startswith("ordi") for t in many)
    rows = [(1, f"filler{i} common") for i in range(6)] + [(0, f"filler{i} common") for i in range(6, 16)] + [(0, f"filler{i}") for i in range(16, 300)]
    assert not any(t.startswith("comm") for t in toxicity.learn_lexicon(spark.createDataFrame(rows, "label int, text string").repartition(300)))


def test_first_letter_edits_are_hits(spark):
    words = ["1diot", "xdiot", "diot", "@athetic", "athetic", "xxathetic"]
    lexicon = toxicity.Lexicon({"idiot": False, "pathetic": True, "scum": False})
    assert lexicon.hits({*words, "xcum", "cum", "xxdiot", "other"}) == {"1diot": 2, "@athetic": 2, "xdiot": 3, "diot": 3, "athetic": 3}
    model = toxicity.learn_toxicity(spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    docs = spark.createDataFrame([(-1, "what a day this is")] + [(i, f"what a {w} this is") for i, w in enumerate(words)], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    base = scores.pop(-1)
    assert all((s > base) == (i < 5) for i, s in scores.items())


def test_free_automaton_equals_plain_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    terms, rng, words = {"idiot": False, "worthless": False, "loweis": True, "scum": False}, random.Random(8), set()
    for t in terms:
        for _ in range(300):
            w = list(t + rng.choice(["", "", "abc"]))
            for _ in range(rng.randrange(0, 4)):
                k = rng.randrange(min(3, len(w) + 1))
                w[k : k + rng.randrange(0, 2)] = rng.choice(["", "a", "i", "x"])
            words.add("".join(w))
    got = {w: min(k, 2) for w, k in toxicity.Lexicon(terms).hits(words).items()}
    for w in words:
        least = {t: min(distance(h, t) for h in ([w[:k] for k in range(len(w) + 1)] if stem else [w])) for t, stem in terms.items()}
        assert got.get(w, 0) == (1 if 0 in least.values() else 2 if any(d <= toxicity.edits_allowed(t) for t, d in least.items()) else 0), w


def _leaks(spark, docs, items):
    docs = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()}


def test_leaks_with_other_word_counts_and_partial_copies(spark):
    item = "some people who live in the small town near the river say that Mary Ann once walked all the way to the old mill and came back home before dark"
    half = "the road that runs 12 km along the lake is closed in winter and the people of the village walk over the hills then take the bus which needs 12 min"
    docs = [
        item.replace("Mary Ann", "Bob"), item.replace("once walked", "once slowly walked"), "Intro here. " + item.replace("Mary Ann", "Anna Maria Lee") + " End.",
        " ".join(half.split()[:23]) + " they like and then for 99 min nothing else happens there at all",
        half.replace("12 min", "99 min"),
    ]
    assert _leaks(spark, docs, [item, half]) == {(0, 0), (1, 0), (2, 0), (3, 1)}


def test_items_without_literal_windows_and_embedded_short_items(spark):
    sums = "12 + 30 = 42 and 17 + 25 = 42 and 11 + 12 = 23 so 42 + 23 = 65"
    names = "Alice, Bobby, Carol, David, Erika, Frank, Georg, Helen, Irene, Jonas, Karla"
    title = "The Quick Brown Fox Jumps Over The Lazy Dog Again And Again"
    short = "Which river flows through the old town"
    docs = [f"he wrote {sums} and left", f"present were {names} today", f"a book called {title} by nobody", "he asked Which river flows through the old town and left", "he asked Whose river flows through the old town and left", "he wrote 13 + 31 = 44 and 18 + 26 = 44 and 19 + 20 = 39 but 1 + 2 = 3"]
    assert _leaks(spark, docs, [sums, names, title, short]) == {(0, 0), (1, 1), (2, 2), (3, 3)}


def test_repeated_ids_do_not_use_up_places(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(30)]
    want = sorted(range(1, 30), key=lambda i: (sum((a - b) ** 2 for a, b in zip(rows[i][1], rows[0][1], strict=True)), i))[:10]
    odd = [(100 + i, [1.0, 2.0]) for i in range(20)]
    for repeated in (rows * 2, rows + [rows[want[0]]] * 12):
        found = ann.nearest(spark.createDataFrame(repeated + odd, "vec_id long, embedding array<double>")).filter("query_id = 0").orderBy("rank").collect()
        assert [(r["rank"], r.vec_id) for r in found] == list(enumerate(want, 1))


def test_one_odd_vector_does_not_drop_the_table(spark):
    for odd in range(1000, 1008):
        rows = [(i, [float(i), 1.0]) for i in range(5)] + [(odd, [1.0, 2.0, 3.0])]
        assert ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).filter("query_id = 0").count() == 4


def test_large_lexicons_are_kept_whole(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(2500)})
    rows = [(1, " ".join(words))] * 6 + [(0, "nothing here")] * 200
    found = toxicity.learn_lexicon(spark.createDataFrame(rows, "label int, text string"))
    assert toxicity.LEARN_ROWS >= 20_000 and all(w in found or any(w[:k] in found for k in toxicity.STEMS) for w in words)


def test_distances_beyond_doubles_are_candidates(spark):
    rows = [(0, [1e200, 0.0]), (1, [-1e300, 1.0]), (2, [-1e300, 2.0]), (3, [1e200, 1.0])]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [r.vec_id for r in found] == [3, 1, 2] and found[0].score == 1.0 and found[1].score == float("inf")


def test_two_levels_of_partitions_equal_brute_force(spark):
    rng = np.random.Generator(np.random.PCG64(4))
    centres = rng.standard_normal((60, 8)) * 6
    x = centres[rng.integers(0, 60, 6000)] + rng.standard_normal((6000, 8))
    frame = spark.createDataFrame([(i, v.tolist(), i) for i, v in enumerate(x)], "vec_id long, embedding array<double>, part int")
    got, hits = {}, 0
    for r in ann.nearest(frame, sample_rows=256, rows_a_partition=64, block_rows=100).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sorted(got) == list(range(0, 6000, 100)) and {len(v) for v in got.values()} == {10}
    for q, found in got.items():
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(found & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hits >= 0.9 * 10 * len(got)


CROWNS = ["the lower price is closer to the crown", "A clone of the crown was lost in the crash", "the crash was lower than the crown and closer", "we were discussing the lover of thrash and brash ideas"]


def test_scores_of_the_learned_model_are_in_order(spark, sf_dir):
    """On a model that the query's own labels teach: disguise and address raise, quotation lowers, ordinary words do little."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.learn_toxicity(docs, labels.filter("crc32(cast(doc_id as string)) % 3 <> 1"))
    assert (model.weights[:-1] >= 0).all() and not any(model.terms.get(w[:k]) for w in toxicity.INSULTS for k in (3, 4))
    texts = ["a long day went by and that is all", "you are an 1diot and that is all", "he is an idiiot and that is all", "he is an idiot and that is all", "you are an idiot and that is all", 'he said "an idiot" and that is all', *CROWNS]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    none, leet, twice, plain, told, quoted, *crowns = (r.score for r in toxicity.score_toxicity(rows, model).orderBy("doc_id").collect())
    assert leet > none and twice > none and told > plain > quoted >= none and plain >= twice and max(crowns) < 0.3, (none, leet, twice, plain, told, quoted, crowns)


def test_ordinary_words_and_insults_need_their_own_evidence(spark):
    rows = [(0, f"the clown lost his crown x{i}") for i in range(40)] + [(1, f"scum and crawn y{i}") for i in range(12)]
    frame = spark.createDataFrame(rows, "label int, text string")
    terms = toxicity.learn_lexicon(frame)
    assert "clown" not in terms and terms["idiot"] is False and terms["idiots"] is False and "scum" in terms
    assert toxicity.ordinary_words(frame, {"clown": False}) == {"crown"}
    assert toxicity.Lexicon({"clown": False}, frozenset({"crown"})).hits({"crown", "crawn", "clawn", "clown", "cl0wn", "cllown"}) == {"clawn": 3, "clown": 1, "cl0wn": 2, "cllown": 2}


def test_the_learning_bound_counts_rows_of_documents(spark):
    docs = spark.createDataFrame([(i % 50, f"t{i}") for i in range(200)] + [(70, "much")] * 90, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1000)], "doc_id long, toxic int")
    for bound in (1, 10, 60):
        got = toxicity.learning_rows(docs, labels, "toxic", bound)
        assert bound - 4 < got.count() <= bound and got.filter("text = 'much'").count() == 0
    assert toxicity.learning_rows(docs, labels, "toxic", 1000).count() == 290
