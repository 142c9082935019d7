"""Codes of vectors: each of their parts by the nearest of a codebook's entries, learned by ball k-means, exactly.

An entry and the parts assigned to it are a ball. Its radius is the largest distance of its parts to it, plus what the
entry moved since: the next round needs no pass of its own to bound it. Only entries within twice the radius (its
neighbours) can take a part from a ball. For a part at distance d of its entry, only those of them count which are
within 2 d of the entry: neighbours are sorted by distance, so each part has a ring, and is compared with the entries up
to its ring and no others. Parts nearer than half the way to the nearest neighbour are the ball's stable core and are
compared with nothing; a ball is left as it is when neither its entry nor a neighbour moved. All tests and distances
are in whole numbers, so the codes are those of a full search. At first every part is in the ball of entry 0.

A round reads vectors and codes, writes vectors and new codes (a table in the shared folder, which is where a lost
executor's work starts again), and adds up parts by entry: a row of sums for each entry and task.

Cases: vectors that are null or hold null or non-finite components take no part, nor do those of another length than
`width` (the most frequent length that can be cut into equal parts, if not given) or with whole numbers beyond
vectors.largest_component; null ids take part, and come last as first entries; rows that repeat an id are vectors of
their own; ties go to the lower index; fewer vectors than entries are as many entries; an empty table gives an empty
result; null labels are one label; other columns are not looked at. A label that a third of all rows have is added up
before it is shuffled, and its sum reaches the rows by a broadcast (up to BROADCAST_LABELS labels by count, else by
label and one of SALTS salts).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut
from .vectors import common_width, matrix, sums_by, whole_vectors

BROADCAST_LABELS, SALTS, CHUNK = 200_000, 32, 512


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances between rows of whole numbers: in doubles where all terms stay below 2^53."""
    peak = max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * peak * peak < 1 << 53 else np.int64
    a, b = x.astype(kind), y.astype(kind)
    return ((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None] - 2 * a @ b.T).astype(np.int64)


@dataclass(frozen=True)
class Balls:
    """The entries of one part's codebook with the radii of their balls; settled balls keep their parts."""

    entries: np.ndarray
    radius: np.ndarray
    settled: np.ndarray

    def neighbours(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each ball, the entries within twice its radius, nearest first, and from which squared distance on a part
        may be as near to them: a quarter of the entries' squared distance, rounded up."""
        gaps = -(-squared_distances(self.entries, self.entries) // 4)
        reach = (self.radius * (1 + 1e-9)) ** 2 + 1
        out = []
        for i, row in enumerate(gaps):
            near = np.flatnonzero((row <= reach[i]) & (np.arange(len(row)) != i))
            near = near[np.argsort(row[near], kind="stable")]
            out.append((near, row[near]))
        return out

    def reassign(self, x: np.ndarray, codes: np.ndarray, neighbours: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry of each part, the lower of equals, and the squared distance to it; codes are those so far."""
        least, codes = ((x - self.entries[codes]) ** 2).sum(axis=1), codes.copy()
        order = np.argsort(codes, kind="stable")
        found, starts = np.unique(codes[order], return_index=True)
        for i, rows in zip(found, np.split(order, starts[1:]), strict=True):
            near, gaps = neighbours[i]
            if self.settled[i] or not len(near):
                continue
            ring = np.searchsorted(gaps, least[rows], side="right")
            by_ring = np.argsort(-ring, kind="stable")
            rows, ring = rows[by_ring], ring[by_ring]
            rows, ring = rows[ring > 0], ring[ring > 0]
            for at in range(0, len(rows), CHUNK):
                some, rings = rows[at : at + CHUNK], ring[at : at + CHUNK]
                others = near[: rings[0]]
                d = squared_distances(x[some], self.entries[others])
                d[np.arange(len(others))[None] >= rings[:, None]] = np.iinfo(np.int64).max
                best = d.min(axis=1)
                entry = np.where(d == best[:, None], others[None], len(self.entries)).min(axis=1)
                better = (best < least[some]) | ((best == least[some]) & (entry < i))
                codes[some[better]], least[some[better]] = entry[better], best[better]
        return codes, least


def _moved(balls: Balls, entries: np.ndarray, furthest: np.ndarray) -> Balls:
    """The balls around the new entries; furthest: largest squared distance of a ball's parts to its old entry."""
    shift = np.sqrt(((entries - balls.entries) ** 2).sum(axis=1).astype(float))
    new = Balls(entries, np.sqrt(furthest.astype(float)) + shift, np.zeros(len(entries), bool))
    still = shift == 0
    settled = np.array([still[i] and still[near].all() for i, (near, _) in enumerate(new.neighbours())], bool)
    return Balls(entries, new.radius, settled)


def learn_codes(rows: DataFrame, width: int, parts: int, entries: int, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """rows: vec_id, label and v, whole numbers. Gives vec_id, label, codes (a byte for each part) and error, and the
    codebooks as [part, entry, position]."""
    size = width // parts
    first = rows.select("v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    books = np.array([r["v"] for r in first], np.int64).reshape(-1, parts, size).transpose(1, 0, 2)
    n = books.shape[1]
    balls = [Balls(b, np.full(n, np.inf), np.zeros(n, bool)) for b in books]
    kept = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    table = rows.withColumn("codes", F.lit(bytes(parts)))

    def split(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)
        return matrix(batch.column("v")).reshape(-1, parts, size), codes

    def reassigned(it: Iterator[pa.RecordBatch], balls: list[Balls], last: bool) -> Iterator[pa.RecordBatch]:
        near = [b.neighbours() for b in balls]
        for batch in it:
            if batch.num_rows:
                x, codes = split(batch)
                both = [balls[p].reassign(x[:, p], codes[:, p], near[p]) for p in range(parts)]
                text = np.stack([c for c, _ in both], axis=1).astype(np.uint8).tobytes()
                new = pa.array([text[i : i + parts] for i in range(0, len(text), parts)], pa.binary())
                rest = {"error": pa.array(sum(d for _, d in both))} if last else {"v": batch.column("v")}
                yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "label": batch.column("label"), "codes": new, **rest})

    def sums(it: Iterator[pa.RecordBatch], balls: list[Balls]) -> Iterator[pa.RecordBatch]:
        count, total, far = np.zeros((parts, n), np.int64), np.zeros((parts, n, size), np.int64), np.zeros((parts, n), np.int64)
        for batch in it:
            if batch.num_rows:
                x, codes = split(batch)
                for p in range(parts):
                    c, s = sums_by(codes[:, p], n, x[:, p])
                    count[p], total[p] = count[p] + c, total[p] + s
                    np.maximum.at(far[p], codes[:, p], ((x[:, p] - balls[p].entries[codes[:, p]]) ** 2).sum(axis=1))
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), pa.array(far[p, e]), pa.array(total[p, e].tolist(), pa.list_(pa.int64()))], names=["p", "e", "n", "far", "s"])

    for _ in range(rounds):
        table = cut(table.mapInArrow(lambda it, b=balls: reassigned(it, b, False), f"{kept}, codes binary, v array<int>"), "codes")
        added = table.select("v", "codes").mapInArrow(lambda it, b=balls: sums(it, b), "p int, e int, n long, far long, s array<long>")
        added = added.groupBy("p", "e").agg(F.sum("n"), F.max("far"), *(F.sum(F.get("s", F.lit(j))) for j in range(size)))
        new, furthest = books.copy(), np.zeros((parts, n), np.int64)
        for p, e, count, far, *s in added.collect():
            new[p, e], furthest[p, e] = [x // count for x in s], far
        balls, books = [_moved(b, new[p], furthest[p]) for p, b in enumerate(balls)], new
    return cut(table.mapInArrow(lambda it, b=balls: reassigned(it, b, True), f"{kept}, codes binary, error long"), "codes"), books


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, width: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code (two hex digits a part), error (squared distance to the coded vector), label_error (errors summed
    over rows of the same label) and the SHA-256 of all codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has a byte for each part, so there are 1 to 256 entries")
    width = width or common_width(vectors, vector_col, parts) or parts
    rows = whole_vectors(vectors, scale, width, vector_col, vec_id=id_col, label=label_col)
    coded, books = learn_codes(rows, width, parts, entries, rounds)
    by_label = cut(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"), "labels")
    same = F.col("label").eqNullSafe(F.col("_label"))
    if by_label.count() <= BROADCAST_LABELS:
        joined = coded.join(F.broadcast(by_label), same)
    else:
        salted = by_label.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "codes", "error"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("salt") == F.col("_salt")))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return joined.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
