"""Removal of passages that recur, by sharded Aho-Corasick automata over recurring phrases.

A window is 35 consecutive words; a word goes when a window that covers it has the same word sequence as a window that
starts anywhere else, in this document or another.

1. Every window picks an anchor: the 10-word phrase of least hash inside it. Equal windows pick the same phrase, so
   only windows around phrases that occur twice can recur (about one phrase in thirteen words is ever looked at).
2. Windows around such phrases are confirmed: a 96-bit hash of all 35 words must occur at two places at least.
3. Recurring windows that follow each other at exactly the same places form one passage. Its words are taken from the
   document with the smallest id that holds it.
4. Each shard of documents (about SHARD_BYTES of text) gets the passages whose rarest anchor it holds, compiles them
   (as sequences of word numbers) into one Aho-Corasick automaton, and streams its documents through it. Every
   occurrence found has its words removed; the match is on words, not on hashes. Where even the rarest anchor stands
   at over HOT_ANCHOR places, very many shards have it and very many passages may; such a passage goes to the shards
   that hold its own first window, so never to more of them than it occurs in.

Texts are dealt into shards by their hash, once for all steps. Equal texts (told apart by 96 bits of hash) meet in a
shard and are looked at once, with their number as weight; only texts that hold over a thousandth of all rows (so under a thousand of them) are dealt
over all shards. A shard adds up equal windows of its own before they are shuffled, so a passage in very many
documents is one row for each shard.

Cases: null text has no words (n_words 0, kept_text empty); under 35 words nothing is removed; rows that repeat are
documents of their own, so their windows recur; null ids are allowed; input columns other than the text come back
unchanged, except that n_words, n_removed and kept_text of the input are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import Slice, batches, mix, ngram_hashes, slices

WINDOW, GRAM = 35, 10
SHARD_BYTES = 8 << 20
#: Longer passages are compiled as pieces of so many words; every piece is a window at least.
PIECE = 256
PLACE_BITS = (1 << 40) - 1
#: Texts with over COPIES_AT_LEAST copies and over 1 / HOT_TEXTS of all rows are dealt over all shards.
HOT_TEXTS, COPIES_AT_LEAST = 1000, 100
#: Places from which on an anchor no longer says which shards get a passage.
HOT_ANCHOR = 10_000
_C1, _C2, _C3 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93


def _anchors(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window of a slice: its first word, the word its anchor starts at, and the anchor's hash."""
    if len(s.hashes) < WINDOW:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.int64),)
    grams = mix(ngram_hashes(s.hashes, GRAM, _C1))
    starts = np.flatnonzero(s.doc[: len(s.doc) - WINDOW + 1] == s.doc[WINDOW - 1 :])
    wide = WINDOW - GRAM + 1
    at = np.lib.stride_tricks.sliding_window_view(grams, wide)[starts].argmin(axis=1) + starts if len(starts) else starts
    return starts, at, grams[at].view(np.int64)


def _distinct(docs: pa.Table) -> pa.Table:
    """One row for each text of a shard, with how often it is there as `weight`."""
    key, check = docs.column("key").to_numpy(), docs.column("check").to_numpy()
    order = np.lexsort((check, key))
    key, check = key[order], check[order]
    first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (check[1:] != check[:-1]))))
    return docs.take(pa.array(order[first])).append_column("weight", pa.array(np.diff(np.append(first, len(order)))))


def _parts(docs: pa.Table) -> Iterator[tuple[Slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a shard's distinct texts with their keys, checks and weights."""
    for batch in batches(docs.to_batches()):
        columns = [batch.column(c).to_numpy() for c in ("key", "check", "weight")]
        for s in slices(batch.column("text")):
            yield s, *(c[s.rows.start : s.rows.stop] for c in columns)


def _window_hashes(words: np.ndarray, starts: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of hash of the windows that start at these places of a row of word hashes."""
    h1 = mix(ngram_hashes(words, WINDOW, _C2)[starts]).view(np.int64)
    h2 = mix(ngram_hashes(mix(words + np.uint64(_C2)), WINDOW, _C3)[starts]) >> np.uint64(32)
    return h1, h2.astype(np.uint32).view(np.int32)


def _find_anchors(docs: pa.Table) -> pa.Table:
    """Each anchor of a shard once, and at how many places it stands there."""
    docs = _distinct(docs)
    anchors, times = [], []
    for s, _, _, weight in _parts(docs):
        _, at, anchor = _anchors(s)
        at, first = np.unique(at, return_index=True)
        anchors.append(anchor[first])
        times.append(weight[s.doc[at]])
    anchor, times = np.concatenate(anchors), np.concatenate(times)
    order = np.argsort(anchor)
    anchor, times = anchor[order], times[order]
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1]))) if len(anchor) else np.zeros(0, np.int64)
    shard = np.full(len(first), docs.column("shard")[0].as_py(), np.int32)
    return pa.table([pa.array(shard), pa.array(anchor[first]), pa.array(np.add.reduceat(times, first) if len(first) else times)], names=["shard", "anchor", "times"])


def _by_text(table: pa.Table, columns: list[str]) -> dict[tuple[int, int], list[np.ndarray]]:
    """The columns' values for each key and check."""
    if not table.num_rows:
        return {}
    key, check = table.column("key").to_numpy(), table.column("check").to_numpy()
    order = np.lexsort((check, key))
    key, check = key[order], check[order]
    cuts = np.flatnonzero((key[1:] != key[:-1]) | (check[1:] != check[:-1])) + 1
    parts = [np.split(table.column(c).to_numpy()[order], cuts) for c in columns]
    heads = np.append(0, cuts)
    return {(k, c): list(x) for k, c, *x in zip(key[heads].tolist(), check[heads].tolist(), *parts, strict=True)}


def _rotated(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def _xxhash64(x: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """Spark's xxhash64 of a bigint column (public algorithm, fixed values below)."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    h = (np.full(len(x), seed, np.uint64) if isinstance(seed, int) else seed) + p5 + np.uint64(8)
    h = _rotated(h ^ (_rotated(x.astype(np.int64).view(np.uint64) * p2, 31) * p1), 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def _here(key: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """40 bits of xxhash64(key, pos), to be summed over a window's places."""
    return (_xxhash64(pos, _xxhash64(key, 42)) & np.uint64(PLACE_BITS)).view(np.int64)


def _windows(docs: pa.Table, cand: pa.Table) -> pa.Table:
    """A row for each distinct window around the shard's repeated anchors; here and before are sums over its places in
    the shard, null where there is one place only."""
    names = ["shard", "h1", "h2", "key", "check", "pos", "n", "times", "here", "before"]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    if not (docs.num_rows and cand.num_rows):
        return pa.table([pa.array([], t) for t in types], names=names)
    out = []
    for s, keys, checks, weight, starts, n in _around(docs, cand):
        h1, h2 = _window_hashes(s.hashes, starts)
        doc = s.doc[starts]
        out.append((h1, h2, keys[doc], checks[doc], (starts - s.first[doc]).astype(np.int32), n, weight[doc]))
    if not out:
        return pa.table([pa.array([], t) for t in types], names=names)
    h1, h2, key, check, pos, n, times = (np.concatenate(c) for c in zip(*out, strict=True))
    order = np.lexsort((pos, check, key, h2, h1))
    h1, h2, key, check, pos, n, times = (c[order] for c in (h1, h2, key, check, pos, n, times))
    first = np.flatnonzero(np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))))
    alone = np.diff(np.append(first, len(h1))) == 1
    times, here, before = (np.add.reduceat(c, first) for c in (times, _here(key, pos), _here(key, pos - 1)))
    n = np.minimum.reduceat(n, first)
    # rows of one document stand together again, which packs better
    order = np.lexsort((pos[first], key[first]))
    first, alone = first[order], alone[order]
    shard = np.full(len(first), docs.column("shard")[0].as_py(), np.int32)
    columns = [shard, h1[first], h2[first], key[first], check[first], pos[first], n[order], times[order]]
    return pa.table([*map(pa.array, columns), pa.array(here[order], mask=alone), pa.array(before[order], mask=alone)], names=names)


def _around(docs: pa.Table, cand: pa.Table) -> Iterator[tuple[Slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a shard with the windows around its repeated anchors: keys, checks and weights of the texts, first words
    of the windows, and at how many places their anchors stand."""
    repeated, n_of = cand.column("anchor").to_numpy(), cand.column("n").to_numpy()
    order = np.argsort(repeated)
    repeated, n_of = repeated[order], n_of[order]
    for s, keys, checks, weight in _parts(_distinct(docs)):
        starts, _, anchor = _anchors(s)
        place = np.minimum(np.searchsorted(repeated, anchor), len(repeated) - 1)
        hit = np.flatnonzero(repeated[place] == anchor)
        if len(hit):
            yield s, keys, checks, weight, starts[hit], n_of[place[hit]]


def _holders(docs: pa.Table, cand: pa.Table, hot_anchor: int) -> pa.Table:
    """What a shard holds: its repeated anchors (with 0) that stand at up to hot_anchor places, and around the others the
    hashes of the distinct windows."""
    hot = cand.column("n").to_numpy() > hot_anchor
    found = np.zeros(0, [("k1", np.int64), ("k2", np.int32)])
    if docs.num_rows and hot.any():
        for s, _, _, _, starts, _ in _around(docs, cand.filter(pa.array(hot))):
            new = np.zeros(len(starts), found.dtype)
            new["k1"], new["k2"] = _window_hashes(s.hashes, starts)
            found = np.unique(np.concatenate((found, new)))
    k1 = np.concatenate((cand.column("anchor").to_numpy()[~hot], found["k1"]))
    k2 = np.concatenate((np.zeros(len(k1) - len(found), np.int32), found["k2"]))
    shard = np.full(len(k1), cand.column("shard")[0].as_py() if len(k1) else 0, np.int32)
    return pa.table({"shard": pa.array(shard), "k1": pa.array(k1), "k2": pa.array(k2)})


def _passages(docs: pa.Table, recurring: pa.Table, hot_anchor: int) -> pa.Table:
    """Passages with what names the shards that get them: their rarest anchor and 0, or the hash of their first window."""
    k1s, k2s, pieces = [], [], []
    found = _by_text(recurring, ["pos", "n", "times", "here", "before"])
    if found:
        texts = zip(docs.column("key").to_pylist(), docs.column("check").to_pylist(), strict=True)
        docs = _distinct(docs.filter(pa.array([t in found for t in texts], pa.bool_())))
        for s, keys, checks, _ in _parts(docs):
            first_words, _, anchor = _anchors(s)
            anchor_of = np.zeros(len(s.hashes), np.int64)
            anchor_of[first_words] = anchor
            for i, text in enumerate(zip(keys.tolist(), checks.tolist(), strict=True)):
                pos, n, times, here, before = found[text]
                order = np.argsort(pos)
                pos, n, times, here, before = (x[order] for x in (pos, n, times, here, before))
                new = (np.diff(pos) != 1) | (times[1:] != times[:-1]) | (before[1:] != here[:-1])
                cuts = np.concatenate(([0], np.flatnonzero(new) + 1, [len(pos)]))
                words = s.words(i)
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    rarest = a + n[a:b].argmin()
                    named = int(anchor_of[s.first[i] + pos[rarest]]), 0
                    start, end = int(pos[a]), int(pos[b - 1]) + WINDOW
                    while start < end:
                        stop = start + PIECE if end - start - PIECE >= WINDOW else end
                        if n[rarest] > hot_anchor:
                            at = s.first[i] + start
                            named = tuple(int(h[0]) for h in _window_hashes(s.hashes[at : at + WINDOW], slice(None)))
                        k1s.append(named[0])
                        k2s.append(named[1])
                        pieces.append(b" ".join(words[start:stop]))
                        start = stop
    return pa.table({"k1": pa.array(k1s, pa.int64()), "k2": pa.array(k2s, pa.int32()), "piece": pa.array(pieces, pa.binary())})


def text_key(text: Column) -> Column:
    """What deals texts into shards; F.hash tells those with one key apart."""
    return F.xxhash64(text)


def _remover(names: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def remove(docs: pa.Table, patterns: pa.Table) -> pa.Table:
        import ahocorasick

        vocabulary: dict[bytes, int] = {}
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for piece in set(patterns.column("piece").to_pylist()):
            ids = tuple(vocabulary.setdefault(w, len(vocabulary) + 1) for w in piece.split())
            automaton.add_word(ids, len(ids))
        automaton.make_automaton()
        number, n_words, n_removed, kept_text = vocabulary.get, [], [], []
        done: dict[tuple[int, int], tuple[int, int, str]] = {}
        for *names_of_text, text in zip(*(docs.column(c).to_pylist() for c in ("key", "check", "text")), strict=True):
            key = tuple(names_of_text)
            if key in done:
                for column, value in zip((n_words, n_removed, kept_text), done[key], strict=True):
                    column.append(value)
                continue
            words = (text or "").encode().split()
            gone = np.zeros(len(words) + 1, np.int32)
            if vocabulary and len(words) >= WINDOW:
                for end, length in automaton.iter(tuple([number(w, 0) for w in words])):
                    gone[end + 1 - length] += 1
                    gone[end + 1] -= 1
            kept = np.cumsum(gone[:-1]) == 0
            n_words.append(len(words))
            n_removed.append(len(words) - int(kept.sum()))
            if n_removed[-1]:
                words = [w for w, k in zip(words, kept.tolist(), strict=True) if k]
            kept_text.append(b" ".join(words).decode())
            done[key] = n_words[-1], n_removed[-1], kept_text[-1]
        docs = docs.select(names)
        return pa.table([*docs.columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_text, pa.string())], names=[*names, "n_words", "n_removed", "kept_text"])

    return remove


def remove_repeats(docs: DataFrame, text_col: str = "text", shard_bytes: int = SHARD_BYTES, hot_anchor: int = HOT_ANCHOR) -> DataFrame:
    """The rows of docs without text_col, with n_words, n_removed and kept_text (kept words joined by one space)."""
    others = [c for c in docs.columns if c not in (text_col, "n_words", "n_removed", "kept_text")]
    docs = docs.select(F.col(text_col).alias("text"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(others)))
    carried = [f"c{i}" for i in range(len(others))]
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(8, ceil(size / shard_bytes))
    # equal texts have equal keys; the few texts with very many copies are dealt over all shards
    docs = docs.withColumns({"key": text_key(F.col("text")), "check": F.hash("text")})
    counts = docs.groupBy("key").agg(F.count("*").alias("copies"))
    most = counts.agg((F.sum("copies") / HOT_TEXTS).alias("most"))
    hot = [r["key"] for r in counts.join(F.broadcast(most), F.col("copies") > F.greatest("most", F.lit(COPIES_AT_LEAST))).select("key").collect()]
    spread = F.when(F.col("key").isin(hot), F.pmod(F.xxhash64("key", *carried), F.lit(shards))).otherwise(F.lit(0)) if hot else F.lit(0)
    docs = docs.withColumn("shard", F.pmod(F.pmod("key", F.lit(shards)) + spread, F.lit(shards)).cast("int"))

    by_shard = docs.groupBy("shard")
    anchors = by_shard.applyInArrow(_find_anchors, "shard int, anchor long, times long")
    # a shard has an anchor once, so no anchor has more rows than there are shards
    cand = anchors.repartition("anchor").withColumn("n", F.sum("times").over(Window.partitionBy("anchor"))).filter("n > 1")
    cand = cand.select("shard", "anchor", F.least("n", F.lit(2**31 - 1)).cast("int").alias("n"))

    windows = by_shard.cogroup(cand.groupBy("shard")).applyInArrow(_windows, "shard int, h1 long, h2 int, key long, check int, pos int, n int, times long, here long, before long")
    # shards have added up their own; equal rows of different shards meet once
    windows = windows.repartition("h1", "h2")
    place = lambda pos: F.xxhash64("key", pos.cast("long")).bitwiseAND(PLACE_BITS)
    recurring = windows.groupBy("h1", "h2").agg(
        F.sum("times").alias("times"), F.min(F.struct("key", "check", "pos", "shard")).alias("at"), F.min("n").alias("n"),
        F.try_sum(F.coalesce("here", place(F.col("pos")))).alias("here"), F.try_sum(F.coalesce("before", place(F.col("pos") - 1))).alias("before"),
    ).filter("times > 1")
    recurring = recurring.select("at.shard", "at.key", "at.check", "at.pos", "n", "times", F.coalesce("here", F.lit(-1)).alias("here"), F.coalesce("before", F.lit(-2)).alias("before"))
    passages = by_shard.cogroup(recurring.groupBy("shard")).applyInArrow(lambda d, r: _passages(d, r, hot_anchor), "k1 long, k2 int, piece binary")
    holders = by_shard.cogroup(cand.groupBy("shard")).applyInArrow(lambda d, c: _holders(d, c, hot_anchor), "shard int, k1 long, k2 int")
    patterns = holders.join(passages, ["k1", "k2"]).select("shard", "piece")

    types = dict(docs.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in carried), "n_words long, n_removed long, kept_text string"])
    out = by_shard.cogroup(patterns.groupBy("shard")).applyInArrow(_remover(carried), schema)
    return out.select(*(F.col(c).alias(o) for c, o in zip(carried, others, strict=True)), "n_words", "n_removed", "kept_text")
