"""Near-duplicate documents by MinHash bands, odd sketches and an exact check on full shingle sets.

A document's set holds its distinct shingles of five words (A-Z lower-cased). Documents link when
100 * intersection >= 75 * union. 32 bands of 4 MinHash values propose pairs: a pair at similarity 0.75 shares no
band with probability 5e-6. 1024 MinHash samples are folded into a 2048-bit parity bitmap (odd sketch); the population
count of two bitmaps' XOR estimates how many samples differ, with a standard deviation of 0.0165 in the similarity.
Pairs whose estimate lies over 4.5 standard deviations below the threshold are dropped (a pair at the threshold is lost
with probability 3e-6); the full sets of all others are compared.

Equal sets are one class, represented by the smallest id. Classes that share a bucket are compared with one pivot of
the bucket first; once they are known to be connected they need no further comparison. What is left, pairs of
different components in one bucket, is compared by sketches, so no link between components is lost and no group of
copies is expanded into all its pairs. There, shingles that no other text in question has bound how similar a text can
be to any other: texts that can't reach the threshold with any are left out before (a family of texts that share a
template and fill it in each in its own way), pairs that can't in the join. A bucket of over BLOCK_ROWS texts is cut
into blocks, and each two of its blocks are a group of the join of their own, so no task gets a whole large bucket.

Cases: null, empty and blank texts have an empty set and link with nothing; under five words make one shingle; rows
that repeat an id are one node and stay as rows; a null id gets a null component and is kept; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut
from .text import batches, mix, ngram_hashes, slices

SHINGLE, BANDS, ROWS, SAMPLES, BITS = 5, 32, 4, 1024, 2048
NUM, DEN = 75, 100
#: Most bits in which the odd sketches of two documents to be compared may differ: the count expected at similarity
#: 0.675, which is 4.5 standard deviations of the estimate below 0.75.
MOST_BITS = int(np.ceil(BITS / 2 * (1 - np.exp(-2 * 2 * SAMPLES * (1 - 0.675) / BITS))))
PIVOT_ROUNDS, BLOCK_ROWS = 2, 512
_C = 0x9E3779B97F4A7C15
_rng = np.random.Generator(np.random.PCG64(9))
_A = _rng.integers(0, 2**63, size=SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = mix(np.arange(SAMPLES, dtype=np.uint64) + np.uint64(1))


def _shingles(s) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of a slice and the first of each text (texts without words have none)."""
    grams = ngram_hashes(s.hashes, SHINGLE, _C)
    inside = s.doc[: len(grams)] == s.doc[SHINGLE - 1 :] if len(grams) else np.zeros(0, bool)
    grams, owner = grams[inside], s.doc[: len(grams)][inside]
    short = np.flatnonzero((s.n_words > 0) & (s.n_words < SHINGLE))
    if len(short):
        whole = np.array([ngram_hashes(s.hashes[s.first[i] : s.first[i + 1]], int(s.n_words[i]), _C)[0] for i in short])
        grams, owner = np.concatenate((grams, whole + s.n_words[short].astype(np.uint64))), np.concatenate((owner, short))
        order = np.argsort(owner, kind="stable")
        grams, owner = grams[order], owner[order]
    return mix(grams), np.searchsorted(owner, np.arange(len(s.n_words) + 1))


SKETCH = [f"s{k}" for k in range(BITS // 64)]
_SIGNATURE = ", ".join(["doc_id long, n_shingles long, digest binary, bands array<long>", *(f"{c} long" for c in SKETCH)])


def _sign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for batch in batches(it):
        for s in slices(batch.column(1), lower=True):
            ids = batch.column(0).slice(s.rows.start, len(s.rows))
            grams, first = _shingles(s)
            n = np.diff(first)
            full = np.flatnonzero(n)
            sizes, digests = np.zeros(len(n), np.int64), [None] * len(n)
            for i in full:
                own = np.unique(grams[first[i] : first[i + 1]])
                sizes[i], digests[i] = len(own), hashlib.blake2b(own, digest_size=16).digest()
            bands, sketch = [None] * len(n), np.zeros((len(n), len(SKETCH)), np.int64)
            if len(full):
                low = np.stack([np.minimum.reduceat(grams * a, first[full]) for a in _A], axis=1)
                keys = ngram_hashes(mix(low[:, : BANDS * ROWS]).ravel(), ROWS, _C)[::ROWS].reshape(-1, BANDS)
                keys = mix(keys + _SALT[:BANDS]).view(np.int64)
                at = (mix(low ^ _SALT) % np.uint64(BITS)).astype(np.int64) + np.arange(len(full))[:, None] * BITS
                parity = (np.bincount(at.ravel(), minlength=len(full) * BITS) & 1).astype(np.uint8)
                sketch[full] = np.packbits(parity.reshape(-1, BITS), axis=1).view(np.int64)
                for i, k in zip(full, keys, strict=True):
                    bands[i] = k
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(sizes), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), *(pa.array(c.copy()) for c in sketch.T)],
                names=["doc_id", "n_shingles", "digest", "bands", *SKETCH],
            )


def _sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(it):
        for s in slices(batch.column(1), lower=True):
            grams, first = _shingles(s)
            sets = [np.unique(grams[first[i] : first[i + 1]]).tobytes() for i in range(len(s.rows))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.rows.start, len(s.rows)).cast(pa.int64()), pa.array(sets, pa.binary())], names=["id", "grams"])


def _confirm(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(it):
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(x) + len(y) - len(np.union1d(x, y))
            keep.append(DEN * both >= NUM * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _shingle_rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(it, 1 << 20):
        sets = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
        if sets:
            ids = np.repeat(batch.column(0).to_numpy(), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(sets))], names=["id", "gram"])


def _alone(sets: DataFrame) -> DataFrame:
    """(rep, alone): how many of a text's shingles no other of the texts has; ids with several texts are left out."""
    rows = sets.mapInArrow(_shingle_rows, "id long, gram long")
    own = rows.groupBy("gram").agg(F.count("*").alias("n"), F.min("id").alias("rep")).filter("n = 1").groupBy("rep").agg(F.count("*").alias("alone"))
    return own.join(sets.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1"), F.col("rep") == F.col("id"), "left_anti")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges(a, b): comp is the smallest node that can be reached.

    Labels take their neighbours' minimum and then their label's label, until nothing changes; each round is a written
    table. Sums are partial before each shuffle, so a node with very many edges is no hot task.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        up = labels.select(F.col("node").alias("at"), F.col("comp").alias("above"))
        labels = cut(step.join(up, step.comp == up["at"]).select("node", "old", F.least("comp", "above").alias("comp")), "labels")
        changed = labels.filter("comp <> old").limit(1).count()
        labels = labels.select("node", "comp")
        if not changed:
            return labels


def _differing_bits() -> F.Column:
    return sum((F.bit_count(F.col(f"x.s{k}").bitwiseXOR(F.col(f"y.s{k}"))) for k in range(len(SKETCH))), F.lit(0))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id reachable over links) and kept."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = cut(docs.mapInArrow(_sign, _SIGNATURE), "signatures")
    real = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = real.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    members = real.select("doc_id", "digest").distinct().join(classes, "digest").select("doc_id", "rep")
    own = real.join(classes.select("rep", F.col("digest").alias("d")), (F.col("doc_id") == F.col("rep")) & (F.col("digest") == F.col("d")))
    own = own.dropDuplicates(["rep", "digest"])
    buckets = own.select("rep", F.posexplode("bands").alias("band", "key")).distinct()
    shared = buckets.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo <> hi").select("key")
    live = cut(buckets.join(shared, "key"), "buckets")
    # an id that stands for several texts joins their classes
    several = members.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    repeated = cut(members.join(several, "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "links")
    compared = live.select("rep").distinct()
    signs = cut(own.join(compared, "rep", "left_semi").select("rep", "n_shingles", "bands", *SKETCH), "signs")
    nodes = compared.union(repeated.select("a")).union(repeated.select("b")).distinct()
    sets = cut(docs.join(compared, docs.doc_id == compared.rep, "left_semi").mapInArrow(_sets, "id long, grams binary").dropDuplicates(["id", "grams"]), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs, "pairs")
        x, y = sets.select(F.col("id").alias("a"), F.col("grams").alias("x")), sets.select(F.col("id").alias("b"), F.col("grams").alias("y"))
        return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(_confirm, "a long, b long")

    labels = cut(nodes.select("rep", F.col("rep").alias("comp")), "labels")

    def relabel(found: DataFrame) -> DataFrame:
        found = found.join(labels.select(F.col("rep").alias("a"), F.col("comp").alias("ca")), "a").join(labels.select(F.col("rep").alias("b"), F.col("comp").alias("cb")), "b")
        merged = components(found.filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        return cut(labels.join(merged, labels.comp == merged.node, "left").select("rep", F.coalesce(merged.comp, labels.comp).alias("comp")), "labels")

    def sketches_agree() -> F.Column:
        sizes = (F.col("x.n_shingles") * DEN >= F.col("y.n_shingles") * NUM) & (F.col("y.n_shingles") * DEN >= F.col("x.n_shingles") * NUM)
        return sizes & (_differing_bits() <= MOST_BITS)

    for k in range(PIVOT_ROUNDS):
        rows = live.join(labels, "rep")
        order = F.xxhash64("rep", F.lit(k)) if k == 0 else F.xxhash64("rep", "key", F.lit(k))
        pivots = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.struct(order.alias("o"), "rep", "comp")).alias("p"))
        pivots = pivots.filter("lo <> hi").select("key", F.col("p.rep").alias("b"), F.col("p.comp").alias("cb"))
        near = rows.join(pivots, "key").filter("comp <> cb").select(F.col("rep").alias("a"), "b").distinct()
        near = near.join(signs.alias("x"), F.col("a") == F.col("x.rep")).join(signs.alias("y"), F.col("b") == F.col("y.rep")).filter(sketches_agree())
        best = near.groupBy("a").agg(F.min(F.struct(_differing_bits().alias("bits"), "b")).alias("m"))
        found = confirmed(best.select("a", "m.b"))
        labels = relabel(found if k else found.union(repeated))

    rows = live.join(labels, "rep")
    mixed = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).filter("lo <> hi")
    rows = cut(rows.join(mixed.select("key", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks")), "key"), "mixed")
    alone = _alone(sets.join(rows.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"))
    rows = rows.join(signs, "rep").join(alone, "rep", "left").withColumn("common", F.col("n_shingles") - F.coalesce("alone", F.lit(0)))
    rows = cut(rows.filter(F.col("common") * DEN >= F.col("n_shingles") * NUM).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int")).drop("alone"), "mixed")
    # a pair that shares several buckets is made in the first one only
    first = F.expr("forall(slice(zip_with(x.bands, y.bands, (p, q) -> p = q), 1, x.band), same -> not same)")
    both = F.least("x.common", "y.common")
    can = both * DEN >= (F.col("x.n_shingles") + F.col("y.n_shingles") - both) * NUM
    # the pair of blocks (block, other) has the texts of the one on the left and those of the other on the right
    left = rows.withColumn("other", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1))).alias("x")
    right = rows.withColumnRenamed("block", "other").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("other")))).alias("y")
    same_blocks = F.expr("x.key = y.key and x.block = y.block and x.other = y.other")
    differ = F.expr("x.comp < y.comp or (x.comp > y.comp and x.block <> x.other)")
    cross = left.join(right, same_blocks & differ & can & sketches_agree() & first)
    labels = relabel(confirmed(cross.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()))

    least = labels.groupBy("comp").agg(F.min("rep").alias("component_id"))
    labels = labels.join(least, "comp").select("rep", "component_id")
    named = members.join(labels, "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("component_id", "rep")).alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(named, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
