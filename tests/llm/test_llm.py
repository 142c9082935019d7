"""Operators of the training-data pipeline against brute force, exact round trips and held-out labels."""

import gzip
import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framegauge.llm import ann, decontam, html_extract, language, mixing, near_dup, quality, queries, substring_dedup, toxicity, warc
from framegauge.llm.store import fresh_path
from framegauge.llm.text import ngram_hashes, slices, word_hashes


def _words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Texts with exact and near copies, shared passages, short, blank, empty and null ones, and repeated rows."""
    rng = random.Random(5)
    passage, base = _words(rng, 60, 10_000), _words(rng, 120, 10_000)
    rows = [(i, " ".join(_words(rng, rng.randrange(1, 150), 10_000))) for i in range(40)]
    for i in range(40, 70):
        copy = list(base)
        for _ in range(rng.randrange(0, 10)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(copy)))
    for i in range(70, 80):
        rows.append((i, " ".join(_words(rng, 20, 10_000) + passage[rng.randrange(0, 30) :] + _words(rng, 20, 10_000))))
    rows += [(80, None), (81, ""), (82, " \t\n "), (83, "one two"), (84, "one  two"), (85, "ONE two"), (86, "a b c d e"), (87, "a b c d e"), (None, "alone in null"), (87, "a b c d e")]
    rows += [(90, "again " * 80), (91, "w " + "again " * 50), (92, " ".join(base)), (92, "quite another text under one id")]
    return rows


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, component_id string, shard int").drop("n")


def test_words_and_ngrams_equal_split():
    texts = ["a bb\x0bccc\x1fd  e", None, "", "x" * 200 + " y" * 5, "é ü   z"]
    import pyarrow as pa

    for s in slices(pa.array(texts)):
        for i in range(len(s.rows)):
            assert s.words(i) == (texts[s.rows.start + i] or "").encode().split()
    h = word_hashes(b"aa bb aa bb aa")[2]
    assert h[0] == h[2] != h[1] and len(set(ngram_hashes(h, 3, 0x9E3779B97F4A7C15).tolist())) == 2
    assert word_hashes(b"x" * 100 + b" " + b"x" * 99)[2][0] != word_hashes(b"x" * 99)[2][0]


def test_near_duplicates_equal_brute_force(spark, corpus):
    out = near_dup.near_duplicates(_frame(spark, corpus)).collect()
    sets: dict = {}
    for i, t in corpus:
        w = (t or "").encode().lower().split()
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(s)
    ids = sorted(i for i in sets if i is not None)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and any(100 * len(a & b) >= 75 * len(a | b) > 0 for a in sets[i] for b in sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    want = sorted((str(i), len(s), str(None if i is None else find(i))) for i in sets for s in sets[i])
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out) == want
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in out)
    assert near_dup.near_duplicates(_frame(spark, corpus).limit(0)).count() == 0


def test_repeats_equal_brute_force(spark, corpus):
    rows = corpus + [(200, " ".join(_words(random.Random(1), 700, 10_000)))] * 2
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(_frame(spark, rows), shard_bytes=2000).collect())
    lists = [(t or "").split() for _, t in rows]
    counts: dict = {}
    for w in lists:
        for k in range(len(w) - 34):
            counts[tuple(w[k : k + 35])] = counts.get(tuple(w[k : k + 35]), 0) + 1
    want = []
    for (i, _), w in zip(rows, lists, strict=True):
        gone = set()
        for k in range(len(w) - 34):
            if counts[tuple(w[k : k + 35])] > 1:
                gone |= set(range(k, k + 35))
        want.append((str(i), len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert got == sorted(want) and sum(w[2] for w in want) > 1000
    empty = substring_dedup.remove_repeats(_frame(spark, corpus).limit(0))
    assert empty.count() == 0 and "component_id" in empty.columns


def test_place_hash_is_that_of_spark(spark):
    key, pos = np.array([-5, 3, 2**62], np.int64), np.array([-1, 0, 77], np.int64)
    df = spark.createDataFrame(list(zip(key.tolist(), pos.tolist(), strict=True)), "k long, p long")
    want = [r[0] & substring_dedup.PLACE_BITS for r in df.select(F.xxhash64("k", "p")).collect()]
    assert substring_dedup._here(key, pos).tolist() == want


def test_main_text():
    page = """<html><head><title>t</title></head><body class="has-sidebar"><header><nav><a href=#>Home</a></nav></header><div class="cookie-notice">We use cookies, ok? Yes.</div>
    <div id=content><h1>Title &amp; &lt;more&gt;</h1><p>First paragraph,&nbsp;long enough to count as text, with marks.<br>Next line.<p>Second one <a href=x>with a link</a>, and <b>bo</b>ld text; more words here.
    <ul><li>one<li>two</ul><div class="ad">Buy now, great stuff!</div><script>var x = "<p>no</p>";</script><!-- <p>no</p> --></div>
    <aside><p>Other story, which is long enough, to be text.</p></aside><section id="comments"><p>Nice post, thanks a lot for this, really.</p></section><form><label>mail</label></form><footer>&copy; me</footer>"""
    assert html_extract.main_text(page) == "Title & <more> First paragraph, long enough to count as text, with marks. Next line. Second one with a link, and bold text; more words here. one two"
    assert [html_extract.main_text(x) for x in (None, "", "plain &amp;amp; text", "<p>a<p>b<div>c", "<!-- open", "<script>x")] == ["", "", "plain &amp; text", "a b c", "", ""]


def test_pages_of_the_tables(spark, sf_dir):
    import html
    import re

    rows = queries.op1_main_text(spark, sf_dir).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search("<article>(.*)</article>", pages[r.page_id], re.S)[1]
        inner = re.sub("<[^>]*>", lambda m: "" if re.match("</?b>", m[0]) else " ", inner)
        assert r.text == " ".join(html.unescape(inner).split()) and r.n_chars == len(r.text)


def test_warc_round_trip(spark):
    rng = random.Random(2)
    noise = ["".join(chr(rng.randrange(32, 800)) for _ in range(3000)) for _ in range(20)]
    rows = [(i, f"http://x/{i}", noise[i % 20]) for i in range(60)] + [(60, None, None), (61, "u\r\nv", ""), (62, "a", "é" * 499), (63, "b", "é" * 499), (64, "c", "é" * 500), (65, "d", "é" * 500), (65, "d", "é" * 500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    archives = warc.write_archives(pages, fresh_path(spark, "warc"))
    for size in (997, 1 << 20):
        got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in warc.read_archives(archives, size).collect())
        want = []
        for i, _, h in rows:
            b = (h or "").encode()
            last = max(j for j, _, g in rows if g == h) if len(b) >= 1000 else i
            want.append((i, len(b), hashlib.sha1(b).hexdigest(), "response" if last == i else "revisit", str(None if last == i else last)))
        assert got == sorted(want)
    path = archives.first().path.removeprefix("file://")
    assert gzip.decompress(open(path, "rb").read()).count(b"WARC/1.1\r\n") == archives.first().records
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_false_magic_is_no_member():
    packer = zlib.compressobj(0, zlib.DEFLATED, 31)
    fake = packer.compress(b"WARC/1.1\r\n" + warc.MAGIC * 50) + packer.flush()

    class Memory(io.BytesIO):
        def read_at(self, n, at):
            return self.getvalue()[at : at + n]

    f = Memory(fake)
    at = fake.index(warc.MAGIC, 5)
    assert warc._member(f, at, len(fake)) is None and warc._member(f, 0, len(fake))[1] == len(fake)


def test_nearest_equals_brute_force(spark):
    rng = np.random.Generator(np.random.PCG64(3))
    centres = rng.standard_normal((8, 16)) * 4
    x = centres[rng.integers(0, 8, 1500)] + rng.standard_normal((1500, 16))
    x[700:800] = x[700]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2100, [0.0] * 16), (2200, [float("nan")] * 16), (2300, [None] * 16), (None, x[0].tolist()), (2400, [1.0, 2.0])]
    got: dict = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), rows_a_partition=100, block_rows=64).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 1500, 100))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(1500), d))[:10]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and all(abs(s - d[v]) < 1e-12 for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(want.tolist()))
    assert hits >= 0.9 * 10 * len(got)
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
    few = ann.nearest(spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>")).collect()
    assert [(r.query_id, r["rank"]) for r in few] == [(0, 1), (0, 2), (0, 3)]


def test_templates_catch_other_parameters(spark):
    item = "A train leaves Paris at 12 km per hour and after 30 minutes it meets Alice who walked 12 km from the old town square."
    docs = [
        (1, "Intro. A train leaves London at 17 km per hour and after 45 minutes it meets Bobby who walked 17 km from the old town square. End."),
        (2, "Intro. A train leaves London at 17 km per hour and after 45 minutes it meets Bobby who walked 99 km from the old town square. End."),
        (3, None), (4, ""), (5, "this is a SHORT item of five words indeed"), (None, item), (6, "nothing of the kind is here at all, only some other words"), (7, item), (7, item),
    ]
    bench = spark.createDataFrame([(1, item), (2, "short item of five words"), (3, None), (4, "")], "item_id long, text string")
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string")
    got = sorted((str(r.doc_id), r.item_id, r.changed) for r in decontam.contaminated(frame, bench).collect())
    assert got == [("1", 1, 4), ("5", 2, 0), ("7", 1, 0), ("None", 1, 0)]
    assert decontam.contaminated(frame.limit(0), bench).count() == 0 and decontam.contaminated(frame, bench.limit(0)).count() == 0


def test_leaks_of_the_tables(spark, sf_dir):
    import re

    plain = lambda t: " ".join(re.sub(r"[^\w\s]", "", t.lower()).split())
    docs, items = (spark.read.parquet(f"{sf_dir}/{n}.parquet").collect() for n in ("documents", "benchmark"))
    want = {(d.doc_id, b.item_id) for d in docs for b in items if plain(b.text) in plain(d.text)}
    assert {(r.doc_id, r.item_id) for r in queries.op6_decontamination(spark, sf_dir).collect()} == want


def _pour(weights, caps, budget):
    given, live = dict.fromkeys(weights, 0.0), set(weights)
    while live:
        total, left = sum(weights[k] for k in live), budget - sum(given[k] for k in weights if k not in live)
        full = {k for k in live if caps[k] <= weights[k] * left / total + 1e-9}
        if not full:
            return given | {k: weights[k] * left / total for k in live}
        for k in full:
            given[k] = caps[k]
        live -= full
    return given


def test_budgets_equal_brute_force(spark):
    rng = random.Random(4)
    leaves = [(f"d{d}", f"l{x}", f"s{s}", rng.randrange(10, 2000), d + 1, x + 1, s + 1) for d in range(3) for x in range(2) for s in range(3)]
    frame = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long, w_domain int, w_lang int, w_source int")
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.leaf_budgets(frame.drop("w_domain", "w_lang", "w_source"), frame.drop("tokens"), ["domain", "lang", "source"], 1.6, 2).collect()}
    total = 1.6 * sum(x[3] for x in leaves)
    cap = lambda pick: sum(2 * x[3] for x in leaves if pick(x))
    for d, bd in _pour({f"d{i}": i + 1 for i in range(3)}, {f"d{i}": cap(lambda x, i=i: x[0] == f"d{i}") for i in range(3)}, total).items():
        for l_, bl in _pour({f"l{i}": i + 1 for i in range(2)}, {f"l{i}": cap(lambda x, i=i, d=d: x[:2] == (d, f"l{i}")) for i in range(2)}, bd).items():
            for s, bs in _pour({f"s{i}": i + 1 for i in range(3)}, {f"s{i}": cap(lambda x, i=i, d=d, l_=l_: x[:3] == (d, l_, f"s{i}")) for i in range(3)}, bl).items():
                assert abs(got[d, l_, s] - bs) <= 1


def test_mix_takes_prefixes_of_epochs(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("w" * rng.randrange(0, 30)), "en" if i % 3 else None, f"s{i % 4}", "d") for i in range(200)] + [(None, "a b", "en", "s1", "d"), (300, None, "en", "s1", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, domain string")
    weights = docs.select("domain", F.coalesce("lang", F.lit("unknown")).alias("lang"), "source").distinct().withColumns({"w_domain": F.lit(1), "w_lang": F.lit(1), "w_source": F.lit(1)})
    got = mixing.mix_sources(docs, weights, share=0.9, most_epochs=3).collect()
    size = {i: len((t or "").split()) for i, t, *_ in rows}
    for leaf in {(r.lang, r.source) for r in got}:
        mine = [r for r in rows if (r[2], r[3]) == leaf]
        copies = {r.doc_id: r.copies for r in got if (r.lang, r.source) == leaf}
        whole = min(copies.get(r[0], 0) for r in mine)
        order = sorted(mine, key=lambda r: hashlib.md5(f"7:{whole}:{'null' if r[0] is None else r[0]}".encode()).hexdigest())
        more = [copies.get(r[0], 0) - whole for r in order if size[r[0]]]
        assert more == sorted(more, reverse=True) and set(more) <= {0, 1}
    total = sum(r.copies * r.n_tokens for r in got)
    assert 0.8 * 0.9 * sum(size.values()) < total <= 0.9 * sum(size.values())
    assert mixing.mix_sources(docs.limit(0), weights).count() == 0


def _held_out_accuracy(spark, sf_dir, name, label):
    rows = queries.queries()[name](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").filter("held_out").collect()
    return sum(r.predicted == r[label] for r in rows) / len(rows)


def test_quality_on_held_out_labels(spark, sf_dir):
    assert _held_out_accuracy(spark, sf_dir, "op7_quality", "quality") >= 0.9
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "some text")], "doc_id long, text string")
    counts = quality.text_counts(docs)
    one = quality.fit_discriminant(counts, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, score int"), "quality")
    assert [r.score for r in quality.score_quality(counts, one).collect()] == [1.0] * 3
    none = quality.fit_discriminant(counts.limit(0), spark.createDataFrame([], "doc_id long, quality int"), "quality")
    assert {r.score for r in quality.score_quality(counts, none).collect()} == {0.5} and quality.keep_good(docs, none).count() == 3


def test_toxicity_on_held_out_labels(spark, sf_dir):
    assert _held_out_accuracy(spark, sf_dir, "op10_toxicity", "toxic") >= 0.9


def test_levenshtein_automaton_equals_brute_force():
    terms = {"idiot": False, "pathetic": False, "worthless": False, "loweis": True, "scum": False}
    lexicon = toxicity.Lexicon(terms)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    rng = random.Random(7)
    words = {"idiots", "loweischaft", "lowesschaft", "scum", "scvm", "", "worthles", "wrthlss"}
    for t in terms:
        for _ in range(300):
            w = list(t + rng.choice(["", "", "abc"]))
            for _ in range(rng.randrange(0, 4)):
                k = rng.randrange(len(w) + 1)
                w[k : k + rng.randrange(0, 2)] = rng.choice(["", "a", "i", "x"])
            words.add("".join(w))
    got = lexicon.hits(words)
    for w in words:
        kind = 0
        for t, stem in terms.items():
            heads = [w[:k] for k in range(len(w) + 1)] if stem else [w]
            least = min(distance(h, t) for h in heads)
            if least == 0:
                kind = 1
            elif least <= toxicity.edits_allowed(t) and not kind:
                kind = 2
        assert min(got.get(w, 0), 2) == kind, w


def test_quotation_is_told_from_abuse():
    lexicon = toxicity.Lexicon({"idiot": False})
    assert toxicity.features(lexicon, 'he said "you idiot" to them') == [np.log1p(1) if f == "quoted" else 0.0 for f in toxicity.FEATURES]
    assert toxicity.features(lexicon, "what an idiot this is")[0] == np.log1p(1)
    assert toxicity.features(lexicon, None) == toxicity.features(lexicon, " .. ") == [0.0] * 6
    told, plain = (dict(zip(toxicity.FEATURES, toxicity.features(lexicon, t), strict=True)) for t in ("well you are an idiot", "well this is an idiot"))
    assert told["addressed"] > plain["addressed"] == 0 and told["hits"] == plain["hits"] == plain["plain"]
    assert dict(zip(toxicity.FEATURES, toxicity.features(lexicon, "called you an idiot"), strict=True))["addressed"] == 0


def test_language_on_held_out_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = queries.op8_language(spark, sf_dir).join(docs, "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    odd = spark.createDataFrame([(1, None), (2, "12 !?"), (3, "Ünd")], "doc_id long, text string")
    langs, prototypes = language.learn_profiles(docs)
    assert [r.lang_pred == "und" for r in language.predict_language(odd, langs, prototypes).orderBy("doc_id").collect()] == [True, True, False]
    assert {r.lang_pred for r in language.predict_language(odd, *language.learn_profiles(docs.limit(0))).collect()} == {"und"}


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", None, None, 0), (-2, "two words", "en", "src1", 9)], docs.schema)
    docs = docs.unionByName(odd)
    for name, stage in pipeline.STAGES:
        before = docs
        docs = pipeline.cut(stage(spark, docs, sf_dir), "stage")
        assert docs.columns[: len(columns)] == columns, name
        assert docs.select("doc_id").exceptAll(before.select("doc_id")).count() == 0, name
        if name == "near duplicates":
            assert near_dup.near_duplicates(docs).filter("not kept").count() == 0
        if name == "decontamination":
            assert decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).count() == 0
    assert docs.count() > 0 and docs.filter("copies < 1").count() == 0
    assert stage(spark, docs.select(*columns).limit(0), sf_dir).count() == 0
