"""Toxicity by Levenshtein automata over a lexicon trie, with context windows.

The lexicon holds the words and stems that learning finds, those far more frequent in texts marked toxic than chance
allows, and a short list of common insults as whole words, unless the learning texts speak against one. It is a trie; a
word is run through the automaton of all trie paths within its edit distance, whose states (sets of trie node and edits
so far) are made when first reached and then kept. A term of five letters or more may be missed by one edit, one of
nine or more by two; a stem matches whatever follows it.

A misspelled hit is disguised if it holds a digit or sign (`1diot`, `$cum`) or differs by repeated letters only; that is done
to a term, and counts nearly as the term itself. Other edits make ordinary words of terms (`crown`, `closer`): such
altered hits have a small weight of their own, and words that clean learning texts use are no hits at all.

A hit in quotation marks, or near a reporting word, counts as quotation and as nothing else; any other near a word of
address counts as abuse too. A text's counts go through a logistic model, fitted on the driver with weights of 0 or
more, so that no hit lowers a score, and shrunk towards WEIGHTS, so that what the learning texts lack (say, words of
address) still counts. Disguised hits share the weight of all hits, which plain ones teach.

What is learned comes from at most LEARN_ROWS texts of labelled ids, those ids of least hash (the bound is the parameter
`most_rows`; an id that repeats more often than that is left out); every text is scored whole. Cases: null text counts
as empty; texts without hits (empty ones too) get the model's base score; repeated rows are scored alike, and learned
from as often as they stand there; very long texts are split into words like others; with one label value only the list
of common insults is all there is, with fixed weights; null ids are allowed and never used to learn; other columns are
not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import batches

LEARN_ROWS = 20_000
#: Words and automaton states that a task keeps before it starts anew.
MOST_KNOWN, MOST_STATES = 500_000, 50_000
#: Lengths of the stems that learning looks at, and the log probability by chance that a term must stay under.
STEMS, CHANCE = range(4, 9), -10.0
# Common insults, reporting words and words of address.
INSULTS = "idiot moron stupid pathetic worthless disgusting loser scum trash clown".split()
REPORTING = frozenset("said says quote quoted quotes called calls word words term wrote writes".split())
ADDRESS = frozenset("you your you're youre u ur".split())
SPAN = 4
_EDGES = re.compile(r"^[^\w]+|[^\w]+$")
_OPENING, _CLOSING = "\"'“‘«„(", "\"'”’»“)"
FEATURES = ("hits", "plain", "altered", "quoted", "addressed", "share")
#: Where the weights of FEATURES, and the base, stand before anything is learned.
WEIGHTS = np.array([1.5, 1.5, 0.5, 0.3, 0.5, 2.0, -2.5])
_RUNS = re.compile(r"(.)\1+")


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """terms: word -> False, or stem -> True. Words once seen are remembered, MOST_KNOWN of them.

    ordinary words match only as they are.
    """

    def __init__(self, terms: dict[str, bool], ordinary: frozenset[str] = frozenset()):
        self.ordinary = ordinary
        single = {_RUNS.sub(r"\1", t): stem for t, stem in terms.items()}
        self.words, self.stems = {t for t, stem in single.items() if not stem}, {t for t, stem in single.items() if stem}
        self.children: list[dict[str, int]] = [{}]
        self.final: list[tuple[int, bool] | None] = [None]  # edits allowed, stem
        self.reach = [0]  # most edits that any term below allows
        for term, stem in sorted(terms.items()):
            node, most = 0, edits_allowed(term)
            self.reach[0] = max(self.reach[0], most)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.final.append(None)
                    self.reach.append(0)
                node = self.children[node][c]
                self.reach[node] = max(self.reach[node], most)
            self.final[node] = (most, stem)
        self._reset()

    def _reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.next: list[dict[str, int]] = []
        self.sets: list[tuple] = []
        self.stem: list[int] = []
        self.end: list[int] = []
        self.clean: set[str] = set()
        self.dirty: dict[str, int] = {}
        self.start = self._state({0: 0})

    def _state(self, edits: dict[int, int]) -> int:
        """The automaton's state for trie nodes reached with so many edits, closed under letters left out."""
        todo = list(edits.items())
        while todo:
            node, e = todo.pop()
            if e + 1 <= self.reach[node] and edits[node] == e:
                for child in self.children[node].values():
                    if e + 1 <= self.reach[child] and edits.get(child, 99) > e + 1:
                        edits[child] = e + 1
                        todo.append((child, e + 1))
        key = tuple(sorted(edits.items()))
        if key not in self.states:
            self.states[key] = len(self.next)
            self.next.append({})
            self.sets.append(key)
            self.stem.append(self._ends(key, False))
            self.end.append(self._ends(key, True))
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        edits: dict[int, int] = {}
        for node, e in self.sets[state]:
            if c in self.children[node]:
                child = self.children[node][c]
                edits[child] = min(edits.get(child, 99), e)
            if e < self.reach[node]:
                edits[node] = min(edits.get(node, 99), e + 1)
                for child in self.children[node].values():
                    if e + 1 <= self.reach[child]:
                        edits[child] = min(edits.get(child, 99), e + 1)
        self.next[state][c] = new = self._state(edits) if edits else -1
        return new

    def _ends(self, key: tuple, ended: bool) -> int:
        """1 if a term matches here as it is, 2 if one does with edits, 0 for neither."""
        edits = [e for node, e in key if (f := self.final[node]) and e <= f[0] and (ended or f[1])]
        return 0 if not edits else 1 if min(edits) == 0 else 2

    def _walk(self, word: str) -> int:
        kind, state, steps, stems = 0, self.start, self.next, self.stem
        for c in word:
            after = steps[state].get(c)
            state = self._step(state, c) if after is None else after
            if state < 0:
                return kind
            kind = stems[state] or kind
            if kind == 1:
                return 1
        return self.end[state] or kind if word else 0

    def _kind(self, whole: str) -> int:
        word = bare(whole)
        kind = self._walk(word)
        if kind < 2:
            return kind
        if word in self.ordinary:
            return 0
        single = _RUNS.sub(r"\1", word)
        same = single in self.words or any(single.startswith(t) for t in self.stems) if single != word else False
        return 2 if same or whole[0] in "@$" or any(not c.isalpha() and c not in "'’-" for c in word) else 3

    def hits(self, words: set[str]) -> dict[str, int]:
        """Those of the words (as they stand in a text) that match a term: 1 as it is, 2 disguised, 3 altered."""
        new = words - self.clean
        if not new:
            return {}
        out = {}
        for w in new:
            kind = self.dirty.get(w)
            if kind is None:
                kind = self._kind(w)
                if kind:
                    self.dirty[w] = kind
                else:
                    self.clean.add(w)
            if kind:
                out[w] = kind
        if len(self.clean) > MOST_KNOWN or len(self.next) > MOST_STATES:
            self._reset()
        return out


def bare(word: str) -> str:
    """A word without what surrounds its letters and digits."""
    return word if word.isalnum() else _EDGES.sub("", word)


def features(lexicon: Lexicon, text: str | None) -> list[float]:
    words = (text or "").lower().split()
    kinds = lexicon.hits(set(words))
    if not kinds:
        return [0.0] * len(FEATURES)
    plain = disguised = altered = quoted = addressed = 0
    for i, w in enumerate(words):
        k = kinds.get(w)
        if not k:
            continue
        near = [words[j] for j in range(max(0, i - SPAN), min(len(words), i + SPAN + 1)) if j != i]
        before, after = words[max(0, i - SPAN) : i + 1], words[i : i + SPAN + 1]
        inside = any(x[0] in _OPENING for x in before) and any(x.rstrip(".,;:!?")[-1:] in tuple(_CLOSING) for x in after)
        if inside or any(bare(x) in REPORTING for x in near):
            quoted += 1
            continue
        plain, disguised, altered = plain + (k == 1), disguised + (k == 2), altered + (k == 3)
        addressed += any(bare(x) in ADDRESS for x in near)
    hits = plain + disguised
    return [*(float(np.log1p(n)) for n in (hits, plain, altered, quoted, addressed)), (hits / len(words)) ** 0.5]


def _terms(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each word and stem, the number of toxic and of other texts that hold it."""
    for batch in batches(it):
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = {w for x in set((text or "").lower().split()) if 2 < len(w := bare(x)) < 40 and not w.isdigit()}
            counts[label].update({f"{w} " for w in words} | {w[:k] for w in words for k in STEMS if len(w) >= k})
        # all of them: a term that is rare in this batch may be common in clean texts of the others
        names = list(counts[1] | counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][t] for t in names], pa.int64()), pa.array([counts[0][t] for t in names], pa.int64())], names=["term", "toxic", "clean"])


def learning_rows(docs: DataFrame, labels: DataFrame, label_col: str, most_rows: int) -> DataFrame:
    """label and text of at most most_rows labelled documents, those whose ids have the least hash."""
    labels = labels.select("doc_id", F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)")
    pairs = docs.select("doc_id").join(labels, "doc_id").groupBy("doc_id", "label").agg(F.count("*").alias("rows")).filter(F.col("rows") <= most_rows)
    order = [F.xxhash64("doc_id"), "doc_id", "label"]
    # at most most_rows rows are left for the running sum, and for what is broadcast: texts stay where they are
    upto = F.sum("rows").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    chosen = pairs.orderBy(*order).limit(most_rows).withColumn("upto", upto).filter(F.col("upto") <= most_rows).select("doc_id", "label")
    return docs.join(F.broadcast(chosen.distinct()), "doc_id").select("label", "text")


def _evidence(toxic: str, clean: str, chance: float):  # noqa: ANN202
    """Log probability of so many toxic texts by chance; each clean text costs more than a toxic one gains."""
    return (F.col(toxic) - 8 * F.col(clean)) * chance


def learn_lexicon(rows: DataFrame) -> dict[str, bool]:
    """Terms from rows(label, text): word -> False, stem -> True; the bound on the rows bounds them.

    An insult of the list is a term too, and with an s at its end, unless texts have it and those that are not toxic use
    it more than a quarter as often as toxic ones.
    """
    insults = [w + s for w in INSULTS for s in ("", "s")]
    size = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return dict.fromkeys(insults, False)
    chance = float(np.log(size[1] / (size[0] + size[1])))
    counted = rows.mapInArrow(_terms, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # a term in toxic texts alone comes about with probability rate ** toxic
    good = _evidence("toxic", "clean", chance) < CHANCE
    against = F.col("term").isin([f"{w} " for w in insults]) & (F.col("clean") * size[1] * 4 > F.col("toxic") * size[0])
    order = [F.desc("toxic"), F.desc(F.length("term")), F.asc("term")]
    found, chosen, refused = {}, {}, set()
    below: dict[str, int] = {}  # most toxic texts of any chosen term that begins so
    for r in counted.filter(good | against).withColumn("against", against).orderBy(*order).collect():
        term, n = r["term"], r["toxic"]
        word = term.rstrip(" ")
        if r["against"]:
            refused.add(word)
            continue
        if any(word[:k] in chosen for k in STEMS if k < len(term)) or n < 1.1 * below.get(word, 0):
            continue
        chosen[term] = n
        for k in range(1, len(term) + 1):
            below[term[:k]] = max(n, below.get(term[:k], 0))
    for term in chosen:
        found[term.rstrip(" ")] = not term.endswith(" ") or found.get(term.rstrip(" "), False)
    return dict.fromkeys((w for w in insults if w not in refused), False) | found


def ordinary_words(rows: DataFrame, terms: dict[str, bool]) -> frozenset[str]:
    """Words of clean learning texts that an edit makes of a term, unless toxic texts use them far more."""

    def edited(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms)
        for batch in batches(it):
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                kinds = lexicon.hits(set((text or "").lower().split()))
                counts[label].update({bare(w) for w, k in kinds.items() if k > 1})
            names = list(counts[1] | counts[0])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][t] for t in names], pa.int64()), pa.array([counts[0][t] for t in names], pa.int64())], names=["word", "toxic", "clean"])

    counted = rows.mapInArrow(edited, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    return frozenset(r["word"] for r in counted.filter("clean > 0 and toxic < 8 * clean").select("word").collect())


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """Logistic weights of 0 or more (the last is the base, of any sign), shrunk towards WEIGHTS, by projected Newton steps.

    The weight of altered hits stays what it is: ordinary words are found in the learning texts, so among these altered
    hits are left in toxic ones only.
    """
    x = np.column_stack([x, np.ones(len(x))])
    x[:, FEATURES.index("altered")] = 0
    w, penalty = WEIGHTS.copy(), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * penalty @ (v - WEIGHTS) ** 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + penalty * (w - WEIGHTS)
        # weights at 0 that want to go below stay there
        free = (w > 0) | (slope < 0)
        free[-1] = True
        step = np.zeros(len(w))
        curve = (x.T * (p * (1 - p))) @ x + np.diag(penalty)
        step[free] = np.linalg.solve(curve[np.ix_(free, free)], slope[free])
        size, now = 1.0, loss(w)
        while True:
            new = w - size * step
            new[:-1] = np.maximum(new[:-1], 0)
            if loss(new) <= now or size < 1e-6:
                break
            size /= 2
        moved, w = np.abs(new - w).max(), new
        if moved < 1e-9:
            break
    return w


class ToxicityModel:
    def __init__(self, terms: dict[str, bool], ordinary: frozenset[str], weights: np.ndarray):
        self.terms, self.ordinary, self.weights = terms, ordinary, weights

    def score(self, lexicon: Lexicon, texts: list[str | None]) -> np.ndarray:
        x = np.array([features(lexicon, t) for t in texts]).reshape(-1, len(FEATURES))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def learn_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most_rows: int = LEARN_ROWS) -> ToxicityModel:
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = learning_rows(docs, labels, label_col, most_rows)
    terms = learn_lexicon(rows)
    ordinary = ordinary_words(rows, terms)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms, ordinary)
        for batch in batches(it):
            x = np.array([features(lexicon, t) for t in batch.column(1).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c.copy()) for c in x.T)], names=["label", *FEATURES])

    found = rows.mapInArrow(count, ", ".join(["label int", *(f"{c} double" for c in FEATURES)])).groupBy("label", *FEATURES).count().toArrow()
    y, n = found.column("label").to_numpy().astype(float), found.column("count").to_numpy()
    x = np.stack([found.column(c).to_numpy() for c in FEATURES], axis=1)
    if len(set(y)) < 2:
        return ToxicityModel(terms, ordinary, WEIGHTS)
    return ToxicityModel(terms, ordinary, fit_weights(np.repeat(x, n, axis=0), np.repeat(y, n)))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: toxic likelier)."""

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.terms, model.ordinary)
        for batch in batches(it):
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(model.score(lexicon, batch.column(1).to_pylist()))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(score, "doc_id long, score double")
