"""Nearest neighbours by learned partitions.

A sample of at most SAMPLE_ROWS vectors (those of least hash) is brought to the driver. Its graph of nearest neighbours
is cut into partitions of about equal size: halves along the main axis first, then moves of vertices to where most of
their neighbours are, within a bound on the sizes. A softmax classifier learns, for each sampled vector, how its
neighbours are spread over the partitions. Every vector of the table is put into its likeliest partition; a query goes
to its `probes` likeliest ones. probes is the least number at which that part of the sample which was kept from the
classifier finds RECALL of its true neighbours; where vectors have no structure it comes close to all.

A sample of s vectors can teach s / 32 partitions. A table that needs more gets two levels: each partition's own sample
(of about SAMPLE_ROWS rows again) is cut and learned in the same way, by a task for each partition, and a query goes to
the likeliest inner partitions of its likeliest outer ones. So partitions keep to ROWS_A_PARTITION rows up to
(SAMPLE_ROWS / 32) ** 2 of them, and what a query is compared with does not grow with the table.

Partitions are split into blocks of about BLOCK_ROWS rows by a hash of the id, so that one common vector is no hot
task. Queries are compared with whole blocks on the original vectors in double precision, each block gives its k best,
and the k best of all blocks are ranked.

Cases: vectors that are null, zero, or hold null or non-finite components, or have another length than the
most frequent one, take no part; null ids take no part; rows that repeat an id are one candidate (its nearest vector) and one query
(the nearest of any of them); ties go to the smaller id, and distances beyond the largest double are ties; fewer than k
candidates are all given; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import cut

SAMPLE_ROWS, BLOCK_ROWS, ROWS_A_PARTITION, NEIGHBOURS, RECALL = 4096, 8192, 4096, 10, 0.97


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), k), np.int64)
    squares = (x**2).sum(axis=1)
    for a in range(0, len(x), 512):
        d = squares[a : a + 512, None] + squares[None] - 2 * x[a : a + 512] @ x.T
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out[a : a + len(d)] = np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(x) - 1 else np.argsort(d, axis=1)[:, :k]
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 0.1, rounds: int = 10) -> np.ndarray:
    """Partition number of each vertex; no partition has more than (1 + slack) times its share."""
    part = np.zeros(len(x), np.int64)
    made = 1
    while made < parts:
        for p in range(made):
            rows = np.flatnonzero(part == p)
            centred = x[rows] - x[rows].mean(axis=0)
            axis = np.random.Generator(np.random.PCG64(p)).standard_normal(x.shape[1])
            for _ in range(8):
                axis = centred.T @ (centred @ axis)
                axis /= max(np.linalg.norm(axis), 1e-12)
            part[rows[np.argsort(centred @ axis, kind="stable")[len(rows) // 2 :]]] = made + p
        made *= 2
    most, sizes = ceil(len(x) / parts * (1 + slack)), np.bincount(part, minlength=parts)
    for _ in range(rounds):
        votes = np.zeros((len(x), parts))
        np.add.at(votes, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1)
        np.add.at(votes, (graph.ravel(), np.repeat(part, graph.shape[1])), 1)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), part]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[best[i]] < most:
                sizes[part[i]] -= 1
                sizes[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


@dataclass(frozen=True)
class Router:
    weights: np.ndarray
    bias: np.ndarray
    probes: int

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Partitions of each row, likeliest first."""
        return np.argsort(-(x @ self.weights + self.bias), axis=1, kind="stable")


def _parts_for(n: int, sampled: int, rows_a_partition: int) -> int:
    """Number of partitions, a power of two, for n rows of which so many were sampled."""
    wanted = min(max(1, n // rows_a_partition), max(1, sampled // 32))
    return 1 << (wanted.bit_length() - 1)


def _inner_routers(homes: DataFrame, counts: dict[int, int], width: int, sample_rows: int, rows_a_partition: int, recall: float) -> dict[int, Router]:
    """A router inside each outer partition, fitted by a task for each on a sample of its rows.

    homes: vec_id, v and part. What comes back is one matrix of at most width x sample_rows / 32 for each partition.
    """
    shares = F.get(F.lit([min(1.0, sample_rows / max(1, counts.get(p, 1))) for p in range(max(counts) + 1)]), F.col("part"))
    sample = homes.filter(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 30)) < shares * (1 << 30))

    def fit(table: pa.Table) -> pa.Table:
        part, x = table.column("part")[0].as_py(), _matrix(table.column("v"))
        router = fit_router(x, _parts_for(counts[part], len(x), rows_a_partition), recall=recall)
        return pa.table({"part": pa.array([part], pa.int32()), "probes": pa.array([router.probes], pa.int32()), "weights": [router.weights.ravel().tolist()], "bias": [router.bias.tolist()]})

    found = sample.groupBy("part").applyInArrow(fit, "part int, probes int, weights array<double>, bias array<double>").collect()
    return {r["part"]: Router(np.array(r["weights"]).reshape(width, -1), np.array(r["bias"]), r["probes"]) for r in found}


def fit_classifier(x: np.ndarray, target: np.ndarray, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression on soft targets by gradient descent with momentum."""
    w, b = np.zeros((x.shape[1], target.shape[1])), np.zeros(target.shape[1])
    scale = 1 / max(np.mean((x**2).sum(axis=1)), 1e-12)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - target) / len(x)
        vw, vb = 0.9 * vw - 4 * scale * (x.T @ g), 0.9 * vb - g.sum(axis=0)
        w, b = w + vw, b + vb
    return w, b


def fit_router(x: np.ndarray, parts: int, k: int = NEIGHBOURS, recall: float = RECALL) -> Router:
    if parts < 2 or len(x) < 4 * parts:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1), 1)
    graph = neighbour_graph(x, k)
    part = balanced_partition(x, graph, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1 / graph.shape[1])
    learn = np.arange(len(x)) % 4 != 0
    w, b = fit_classifier(x[learn], target[learn])
    router = Router(w, b, 1)
    order = router.ranked(x)
    placed = order[:, 0]
    # rank, in the order of a query's partitions, of the partition each true neighbour was put into
    place_of = np.argsort(order[~learn], axis=1)
    ranks = np.take_along_axis(place_of, placed[graph[~learn]], axis=1)
    found = [(ranks < m).mean() for m in range(1, parts + 1)]
    return Router(w, b, next(m for m, r in enumerate(found, 1) if r >= recall or m == parts))


def _clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter("vec_id is not null and v is not null")
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    return rows.filter(fine)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(vectors: DataFrame, k: int = NEIGHBOURS, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = SAMPLE_ROWS, rows_a_partition: int = ROWS_A_PARTITION, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) for the queries, the rows whose id is divisible by every."""
    rows = cut(_clean(vectors, id_col, vector_col), "vectors")
    # the most frequent length over all rows, the smaller one of equals
    sizes = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    width = sizes[0]["width"] if sizes else 0
    rows = rows.filter(F.size("v") == width)
    n = sum(r["count"] for r in sizes)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("v").toArrow()
    lists = sample.column("v").to_pylist()
    x = np.array(lists).reshape(-1, width) if width else np.zeros((0, 1))
    parts = _parts_for(n, len(x), rows_a_partition)
    two_levels = n // parts >= 2 * rows_a_partition and parts > 1
    recall = RECALL**0.5 if two_levels else RECALL
    router, inner = fit_router(x, parts, recall=recall), {}
    if two_levels:

        def home(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                if batch.num_rows:
                    best = router.ranked(_matrix(batch.column(1)))[:, 0].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best)], names=["vec_id", "v", "part"])

        outer = rows.mapInArrow(home, "vec_id long, v array<double>, part int")
        counts = {r["part"]: r["n"] for r in outer.groupBy("part").agg(F.count("*").alias("n")).collect()}
        inner = _inner_routers(outer, counts, width, sample_rows, rows_a_partition, recall)
    step = max([1, *(len(r.bias) for r in inner.values())])

    def places(v: np.ndarray) -> list[list[int]]:
        """Partitions of each row, likeliest first: outer ones times step, plus the inner one."""
        ranked = router.ranked(v)[:, : router.probes]
        out: list[list[int]] = [[] for _ in range(len(v))]
        for k in range(ranked.shape[1]):
            for p in np.unique(ranked[:, k]):
                at = np.flatnonzero(ranked[:, k] == p)
                own = inner[p].ranked(v[at])[:, : inner[p].probes] if p in inner else np.zeros((len(at), 1), np.int64)
                for i, found in zip(at, (p * step + own).tolist(), strict=True):
                    out[i] += found
        return out

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(places(_matrix(batch.column(1))), pa.list_(pa.int32()))], names=["vec_id", "v", "parts"])

    placed = rows.mapInArrow(place, "vec_id long, v array<double>, parts array<int>")
    homes = placed.select("vec_id", "v", F.col("parts")[0].alias("part"))
    # one row for each partition, of which there are at most (sample_rows / 32) ** 2
    sizes = cut(homes.groupBy("part").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")), "blocks")
    homes = homes.join(F.broadcast(sizes), "part").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).drop("blocks")
    asked = placed.filter(F.col("vec_id") % every == 0).select("vec_id", "v", F.explode("parts").alias("part"))
    asked = asked.join(F.broadcast(sizes), "part").select(F.col("vec_id").alias("q_id"), F.col("v").alias("q"), F.col("part").alias("q_part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("q_block"))

    def compare(queries: pa.Table, own: pa.Table) -> pa.Table:
        q_ids, ids = queries.column("q_id").to_numpy(), own.column("vec_id").to_numpy()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(q_ids) and len(ids):
            q, v = _matrix(queries.column("q")), _matrix(own.column("v"))
            order = np.argsort(ids, kind="stable")
            ids, v = ids[order], v[order]
            ids, starts = np.unique(ids, return_index=True)
            for i, one in zip(q_ids, q, strict=True):
                # the least distance of each id, before any is left out
                d = np.minimum.reduceat(np.sqrt(((v - one) ** 2).sum(axis=1)), starts)
                others = np.flatnonzero(ids != i)
                d = d[others]
                if len(d):
                    near = np.flatnonzero(d <= np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1])
                    near = near[np.argsort(d[near], kind="stable")][:k]
                    out.append((np.full(len(near), i), ids[others[near]], d[near]))
        parts_ = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(parts_[0], pa.int64()), pa.array(parts_[1], pa.int64()), pa.array(parts_[2], pa.float64())], names=["query_id", "vec_id", "score"])

    found = asked.groupBy("q_part", "q_block").cogroup(homes.groupBy("part", "block")).applyInArrow(compare, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
