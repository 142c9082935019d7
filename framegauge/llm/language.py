"""Language of a text by hyperdimensional profiles.

Every letter (lower-cased; any run of other characters is one gap) has a random vector of +1 and -1. Three letters in
a row are bound into one vector: the element-wise product of the first one's vector rotated by two places, the second
one's by one, and the third one's. A text's hypervector is the sum of its bound vectors; a language's prototype is
the sum of its learning texts' hypervectors, each at length 1, less the mean of all prototypes (what all languages
share). The prediction is the prototype of greatest cosine.

What reaches the driver is a sum for each language and dimension; a column of over MOST_LANGUAGES values is refused
with an error, since it holds no languages. Cases: null text, or one without a letter, gives
`und` and score 0; ties go to the first language in order; learning leaves out null languages and texts without
letters; with nothing learned all is `und`; very long texts are read whole; rows that repeat are learned and predicted
each; null ids are allowed and held out never; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import batches

DIMENSIONS, SEED = 512, 8
#: Prototypes are brought to the driver and sent to every task; more languages than this are refused.
MOST_LANGUAGES = 10_000
#: Texts whose hypervectors are summed in one matrix product.
ROWS = 256
_STEP = 1 << 20
_FOLD: np.ndarray | None = None


def _fold_table() -> np.ndarray:
    """Lower-case code point of each letter of the basic plane, 0 for all else."""
    global _FOLD
    if _FOLD is None:
        fold = np.zeros(1 << 16, np.uint32)
        for cp in range(1 << 16):
            c = chr(cp)
            if c.isalpha():
                fold[cp] = ord(c.lower()[0])
        _FOLD = fold
    return _FOLD


def _letters(text: str) -> np.ndarray:
    """Letters of a text with single gaps (0) before, between and after its words; empty without letters."""
    cps = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    folded = _fold_table()[np.minimum(cps, 0xFFFF)]
    high = np.flatnonzero(cps > 0xFFFF)
    for i in high:
        c = chr(cps[i])
        folded[i] = ord(c.lower()[0]) if c.isalpha() else 0
    folded = np.concatenate(([0], folded, [0])).astype(np.uint32)
    keep = (folded != 0) | np.concatenate(([True], folded[:-1] != 0))
    folded = folded[keep]
    return folded if len(folded) > 2 else folded[:0]


_VECTORS: dict[int, np.ndarray] = {}


def _letter_vector(cp: int) -> np.ndarray:
    if cp not in _VECTORS:
        _VECTORS[cp] = np.random.Generator(np.random.PCG64([SEED, cp])).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1
    return _VECTORS[cp]


def hypervectors(texts: list[str | None]) -> np.ndarray:
    """One row of float32 for each text: the sum of its bound letter triples."""
    out, at = np.zeros((len(texts), DIMENSIONS), np.float32), 0
    while at < len(texts):
        parts, end, size = [], at, 0
        while end < len(texts) and end - at < ROWS and size < _STEP:
            parts.append(_letters(texts[end] or ""))
            size += len(parts[-1])
            end += 1
        if size:
            flat = np.concatenate(parts)
            owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            alphabet, index = _compact(flat)
            m = len(alphabet)
            code = (index[:-2] * m + index[1:-1]) * m + index[2:]
            inside = owner[:-2] == owner[2:]
            code, owner = code[inside], owner[:-2][inside]
            triples, code = _compact(code)
            letters = np.stack([_letter_vector(int(c)) for c in alphabet])
            bound = np.roll(letters, 2, axis=1)[triples // (m * m)] * np.roll(letters, 1, axis=1)[triples // m % m] * letters[triples % m]
            counts = np.bincount(owner * len(triples) + code, minlength=len(parts) * len(triples)).reshape(len(parts), -1)
            out[at:end] = counts.astype(np.float32) @ bound.astype(np.float32)
        at = end
    return out


def _compact(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and each value's place among them; a table replaces sorting while values are small."""
    top = int(values.max()) + 1 if len(values) else 1
    if top > 1 << 24:
        return np.unique(values, return_inverse=True)
    seen = np.zeros(top, bool)
    seen[values] = True
    place = np.cumsum(seen) - 1
    return np.flatnonzero(seen), place[values]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _bundle(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches(it):
        h, langs = _unit(hypervectors(batch.column(1).to_pylist())), np.array(batch.column(0).to_pylist(), object)
        for lang in set(langs):
            sums[lang] = sums.get(lang, 0) + h[langs == lang].sum(axis=0).astype(np.float64)
    for lang, x in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(x)], names=["lang", "d", "x"])


def learn_profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, one row each."""
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    n = rows.select("lang").distinct().count()
    if n > MOST_LANGUAGES:
        raise ValueError(f"{lang_col} has {n} values, more than {MOST_LANGUAGES}: no languages")
    found = rows.mapInArrow(_bundle, "lang string, d int, x double").groupBy("lang", "d").agg(F.sum("x").alias("x")).collect()
    langs = sorted({r["lang"] for r in found})
    sums = np.zeros((len(langs), DIMENSIONS))
    for r in found:
        sums[langs.index(r["lang"]), r["d"]] = r["x"]
    kept = [i for i in range(len(langs)) if np.abs(sums[i]).sum() > 0]
    prototypes = _unit(sums[kept])
    if len(kept) > 1:
        prototypes = _unit(prototypes - prototypes.mean(axis=0))
    return [langs[i] for i in kept], prototypes


def predict_language(docs: DataFrame, langs: list[str], prototypes: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score: the greatest cosine, 0 at least."""
    targets = prototypes.astype(np.float32)

    def predict(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            h = hypervectors(batch.column(1).to_pylist())
            some = np.abs(h).sum(axis=1) > 0
            cos = _unit(h) @ targets.T if langs else np.zeros((len(h), 1), np.float32)
            best = cos.argmax(axis=1)
            pred = [langs[b] if s and langs else "und" for b, s in zip(best, some, strict=True)]
            score = np.where(some, np.clip(cos.max(axis=1), 0, 1), 0).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(predict, "doc_id long, lang_pred string, score double")
