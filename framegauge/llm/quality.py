"""Document quality by a regularised quadratic discriminant over transformed text statistics.

Each text gives counts: of kinds of characters, of repeated words and word triples, and of what it has of characters,
letters and words in all. A statistic is the square root (for word length the logarithm) of a count's share, taken
towards the share in all texts together as if PRIOR characters or words of the average text were added; so a short
text is judged by what it shows and not by its being short. For each label value a mean and a covariance are computed
from sums that Spark adds up over all labelled rows. A covariance is shrunk towards its diagonal and towards the
pooled covariance, and its Cholesky factor is computed once. The score is the logistic function of the difference of
the two log densities (half the difference of the squared Mahalanobis distances and of the log determinants) plus the
log of the prior odds.

Cases: null text counts as empty; empty text has the average text's statistics and is scored like any other; a null id
is never used for learning and is not held out; if one label value only (or none) was learned, every score is that
value (0.5); other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Slice, batches, mix, ngram_hashes, slices

#: Weight of the diagonal, and of the pooled covariance, in a class covariance.
TO_DIAGONAL, TO_POOLED, RIDGE = 0.1, 0.1, 1e-3
#: Characters or words of the average text that are added to each text.
PRIOR = {"size": 200, "letters": 200, "words": 40}
#: Statistics and what each is a share of.
STATISTICS = {
    "word_size": "words", "upper": "letters", "digits": "size", "symbols": "size", "loud": "size", "marks": "size", "wide": "size", "lines": "size",
    "again": "words", "top_word": "words", "same_next": "words", "triples_again": "words", "symbol_ends": "words", "short_words": "words",
}
COUNTS = (*STATISTICS, "size", "letters", "words")
_KIND = np.zeros(256, np.uint8)  # 1 upper, 2 lower, 3 digit, 4 symbol, 5 ! or ?, 6 other marks, 7 above ASCII, 8 line end
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 4
_KIND[[*b"!?"]] = 5
_KIND[[*b".,;:'\"-()"]] = 6
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:], _KIND[10] = 3, 1, 2, 7, 8


def _per_text(s: Slice, values: np.ndarray) -> np.ndarray:
    """Sum of a value per word over each text."""
    sums = np.concatenate(([0], np.cumsum(values)))
    return sums[s.first[1:]] - sums[s.first[:-1]]


def _counts(s: Slice, sizes: np.ndarray) -> np.ndarray:
    """One row for each text: COUNTS."""
    kinds = _KIND[np.frombuffer(s.blob, np.uint8)]
    ends = np.cumsum(sizes + 1) - 1
    counts = []
    for kind in range(1, 9):
        sums = np.concatenate(([0], np.cumsum(kinds == kind)))
        counts.append(sums[ends] - sums[ends - sizes])
    upper, lower, digit, symbol, loud, mark, wide, line = counts
    last = kinds[s.ends - 1] if len(s.ends) else np.zeros(0, np.uint8)
    triples = mix(ngram_hashes(s.hashes, 3, 0x9E3779B97F4A7C15))
    again, top, triples_again = (np.zeros(len(sizes), np.int64) for _ in range(3))
    for i in np.flatnonzero(s.n_words):
        a, b = s.first[i], s.first[i + 1]
        own = np.sort(s.hashes[a:b])
        cuts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True])))
        again[i], top[i] = b - a - len(cuts) + 1, np.diff(cuts).max() - 1
        if b - a > 2:
            triples_again[i] = b - a - 2 - len(np.unique(triples[a : b - 2]))
    same = np.zeros(len(s.hashes), np.int64)
    if len(same) > 1:
        same[1:] = (s.hashes[1:] == s.hashes[:-1]) & (s.doc[1:] == s.doc[:-1])
    ends_odd, short = (last == 4) | (last == 5), s.ends - s.starts <= 2
    word_size = _per_text(s, s.ends - s.starts)
    return np.stack([
        word_size, upper, digit, symbol, loud, mark, wide, line, again, top, _per_text(s, same), triples_again, _per_text(s, ends_odd), _per_text(s, short),
        sizes, upper + lower, s.n_words,
    ], axis=1).astype(np.int64)


def _measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(it):
        raw = batch.column(1).cast(pa.binary())
        sizes = np.array([len(x or b"") for x in raw.to_pylist()], np.int64)
        for s in slices(raw):
            x = _counts(s, sizes[s.rows.start : s.rows.stop])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.rows.start, len(s.rows)).cast(pa.int64()), *(pa.array(c.copy()) for c in x.T)], names=["doc_id", *COUNTS])


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts of each row's text."""
    schema = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS)])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_measure, schema)


def _transformed(counts: np.ndarray, shares: dict[str, float]) -> np.ndarray:
    """The statistics of each row of COUNTS."""
    column = {c: counts[:, i].astype(float) for i, c in enumerate(COUNTS)}
    smooth = [(column[name] + PRIOR[whole] * shares[name]) / (column[whole] + PRIOR[whole]) for name, whole in STATISTICS.items()]
    return np.stack([np.log1p(smooth[0]), *(np.sqrt(x) for x in smooth[1:])], axis=1)


def _matrix(batch: pa.RecordBatch, names: tuple[str, ...]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy() for c in names], axis=1)


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log determinants of the two classes, on standardised statistics."""

    shares: dict[str, float]  # of all texts together
    shift: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    offset: float  # log prior odds and half the difference of the log determinants
    constant: float | None = None

    def scores(self, counts: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(counts), self.constant)
        z = (_transformed(counts, self.shares) - self.shift) / self.scale
        d0, d1 = (((z - m) @ f.T) ** 2 for m, f in zip(self.means, self.factors, strict=True))
        return 1 / (1 + np.exp(-np.clip(self.offset + 0.5 * (d0.sum(axis=1) - d1.sum(axis=1)), -60, 60)))


def fit_discriminant(counts: DataFrame, labels: DataFrame, label_col: str) -> Discriminant:
    """counts as text_counts gives them; labels: doc_id and label_col, 0 or 1 (other values are left out).

    What reaches the driver is one row of sums for all texts and one for each label value.
    """
    d, names = len(STATISTICS), list(STATISTICS)
    sums = counts.agg(*(F.sum(F.col(c).cast("double")).alias(c) for c in COUNTS)).first()
    shares = {name: (sums[name] or 0.0) / (sums[whole] or 1.0) for name, whole in STATISTICS.items()}

    def transform(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = _transformed(_matrix(batch, COUNTS), shares)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c.copy()) for c in x.T)], names=["doc_id", *names])

    statistics = counts.mapInArrow(transform, ", ".join(["doc_id long", *(f"{c} double" for c in names)]))
    rows = statistics.join(labels.select("doc_id", F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)"), "doc_id")
    firsts = [F.sum(c) for c in STATISTICS]
    products = [F.sum(F.col(names[i]) * F.col(names[j])) for i in range(d) for j in range(i + 1)]
    found = {r["label"]: r for r in rows.groupBy("label").agg(F.count("*").alias("n"), F.array(*firsts).alias("sums"), F.array(*products).alias("products")).collect()}
    if len(found) < 2:
        return Discriminant(shares, *[np.zeros(0)] * 4, 0.0, float(next(iter(found), 0.5)))
    n, first, second = [], [], []
    for k in (0, 1):
        n.append(float(found[k]["n"]))
        first.append(np.array(found[k]["sums"]) / n[k])
        square = np.zeros((d, d))
        square[np.tril_indices(d)] = found[k]["products"]
        second.append((square + np.tril(square, -1).T) / n[k])
    total = sum(n)
    shift = (n[0] * first[0] + n[1] * first[1]) / total
    scale = np.sqrt(np.maximum((n[0] * np.diag(second[0]) + n[1] * np.diag(second[1])) / total - shift**2, 1e-12))
    scale[scale < 1e-5] = 1.0
    means = np.stack([(m - shift) / scale for m in first])
    own = [(s - np.outer(m, m)) / np.outer(scale, scale) for s, m in zip(second, first, strict=True)]
    pooled = (n[0] * own[0] + n[1] * own[1]) / total
    factors, logdet = [], []
    for s in own:
        s = (1 - TO_DIAGONAL - TO_POOLED) * s + TO_DIAGONAL * np.diag(np.diag(s)) + TO_POOLED * pooled + RIDGE * np.eye(d)
        lower = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(lower))
        logdet.append(2 * np.log(np.diag(lower)).sum())
    return Discriminant(shares, shift, scale, means, np.stack(factors), float(np.log(n[1] / n[0]) + 0.5 * (logdet[0] - logdet[1])))


def score_quality(counts: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier), from text_counts."""

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(_matrix(batch, COUNTS)))], names=["doc_id", "score"])

    return counts.mapInArrow(score, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Discriminant, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text scores least or more."""

    def keep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            raw = batch.column(text_col).cast(pa.binary())
            sizes = np.array([len(x or b"") for x in raw.to_pylist()], np.int64)
            counts = [_counts(s, sizes[s.rows.start : s.rows.stop]) for s in slices(raw)]
            if counts:
                yield batch.filter(pa.array(model.scores(np.concatenate(counts)) >= least))

    return docs.mapInArrow(keep, docs.schema)
