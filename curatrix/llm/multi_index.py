"""Operator 1: approximate nearest neighbours by cosine with an inverted multi-index.

Unit vectors are cut in two halves, each with its own codebook (k-means on a bounded sample, ``sample`` rows drawn by a
hash of the id). A vector's cell is its pair of centroids. A query walks the pairs by ascending summed distance with a
heap until the cells hold ``share`` of all vectors (``least`` at least); the entries of these cells are reranked by their
cosine on the original vectors, in doubles. Every row is indexed.

The walk ends at a summed distance, so the query travels as its vector and that radius. Entries lie in blocks of whole or
split cells (a cell may be hot), queries in blocks too; a query goes to the blocks where it has a cell, and one task
reranks one block of queries against one block of entries.

``share`` buys recall: on nearly isotropic vectors, whose fifth neighbour is hardly nearer than the rest, half of all vectors
are needed for a recall of 0.96; clustered ones need a small part.

Defined cases: see ``vectors.by_length`` for the rows that take part, each among those of its length (a query that does not has no rows); equal cosines go to
the smaller vec_id; a row is never its own neighbour, and rows with the query's vec_id are the query; fewer candidates
than ``k`` give fewer rows; the walk goes on while it has found no more than ``k`` entries; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatrix.llm.common import Shipped, stored
from curatrix.llm.vectors import by_length, matrix, unit

BLOCK = 2048


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = squared(x, centres).argmin(1)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)


@dataclass
class Codebooks:
    left: np.ndarray
    right: np.ndarray
    counts: np.ndarray | None = None  # vectors by cell
    first: np.ndarray | None = None  # first block of a cell
    parts: np.ndarray | None = None  # blocks of a cell

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.left.shape[1]
        return squared(x[:, :half], self.left), squared(x[:, half:], self.right)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * len(self.right) + b.argmin(1)

    def with_counts(self, counts: np.ndarray) -> Codebooks:
        """Blocks of about BLOCK entries: small cells share one, large cells have several."""
        first, parts, block, held = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, 0
        for cell, n in enumerate(counts.tolist()):
            if n > BLOCK:
                block += held > 0
                first[cell], parts[cell] = block, -(-n // BLOCK)
                block, held = block + int(parts[cell]), 0
                continue
            if held + n > BLOCK:
                block, held = block + 1, 0
            first[cell], held = block, held + n
        return Codebooks(self.left, self.right, counts, first, parts)

    def radius(self, a: np.ndarray, b: np.ndarray, wanted: int) -> float:
        """Summed distance at which a walk over the pairs, nearest first, has met ``wanted`` vectors."""
        i_order, j_order = a.argsort(kind="stable"), b.argsort(kind="stable")
        heap, seen, met, reach = [(a[i_order[0]] + b[j_order[0]], 0, 0)], {(0, 0)}, 0, -np.inf
        while heap:
            reach, i, j = heapq.heappop(heap)
            met += int(self.counts[i_order[i] * len(b) + j_order[j]])
            if met >= wanted:
                break
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(a) and y < len(b) and (x, y) not in seen:
                    seen.add((x, y))
                    heapq.heappush(heap, (a[i_order[x]] + b[j_order[y]], x, y))
        return float(reach)


def fit(rows: DataFrame, n: int, sample: int = 20_000, seed: int = 1) -> Codebooks:
    """Codebooks of 4 * n ** (1/4) centroids each (256 at most), from ``sample`` rows about."""
    drawn = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) < min(1.0, sample / max(1, n)) * (1 << 30)).select("vec_id", "embedding").toArrow().sort_by("vec_id")
    if not drawn.num_rows:
        drawn = rows.select("vec_id", "embedding").limit(1).toArrow()
    x = unit(matrix(drawn.column("embedding").combine_chunks()))
    half, k = -(-x.shape[1] // 2), min(256, int(np.ceil(4 * n**0.25)))
    return Codebooks(k_means(x[:, :half], k, seed), k_means(x[:, half:], k, seed + 1) if x.shape[1] > half else np.zeros((1, 0)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, share: float = 0.5, least: int = 1000, sample: int = 20_000) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found for every row of ``queries`` (a part of ``vectors``)."""
    found = [_nearest_of(rows, queries, k, share, least, sample) for rows in by_length(vectors)]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, found)


def _nearest_of(vectors: DataFrame, queries: DataFrame, k: int, share: float, least: int, sample: int) -> DataFrame:
    """The same among usable vectors of one length."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    n = rows.count()
    books = fit(rows, n, sample)
    plain = Shipped(spark, books)

    def celled(batches):
        one = plain.value
        for batch in batches:
            x = unit(matrix(batch.column("embedding")))
            if len(x):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(one.cells(x))], ["vec_id", "embedding", "cell"])

    entries = stored(rows.mapInArrow(celled, "vec_id long, embedding array<double>, cell long"), "multi-index")
    counts = np.zeros(len(books.left) * len(books.right), np.int64)
    for r in entries.groupBy("cell").agg(F.count("*").alias("n")).collect():  # at most 256 * 256 cells
        counts[r["cell"]] = r["n"]
    books = books.with_counts(counts)
    full = Shipped(spark, books)
    wanted = min(n, max(least, int(np.ceil(share * n)), k + 1))

    ids = queries.select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    asked = entries.join(ids, "vec_id").dropDuplicates(["vec_id"]).select("vec_id", "embedding")
    q_parts = max(1, -(-int(ids.count()) // BLOCK))

    def walk(batches):
        one = full.value
        for batch in batches:
            x = unit(matrix(batch.column("embedding")))
            if not len(x):
                continue
            out = [], [], [], []
            a, b = one.distances(x)
            for r, (vec_id, vector) in enumerate(zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True)):
                reach = one.radius(a[r], b[r], wanted)
                cells = np.flatnonzero(((a[r][:, None] + b[r]).ravel() <= reach) & (one.counts > 0))
                for block in sorted({int(f) + p for f, m in zip(one.first[cells], one.parts[cells], strict=True) for p in range(int(m))}):
                    for column, v in zip(out, (block, vec_id, vector, reach), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.float64())), pa.array(out[3], pa.float64())], ["block", "query_id", "query", "reach"])

    sent = asked.mapInArrow(walk, "block long, query_id long, query array<double>, reach double").withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(q_parts)))

    def dealt(batches):
        one = full.value
        for batch in batches:
            cell, vec = batch.column("cell").to_numpy(), batch.column("vec_id").to_numpy()
            block = one.first[cell] + (vec * np.int64(2654435761) >> np.int64(7)) % one.parts[cell]
            yield pa.RecordBatch.from_arrays([pa.array(block), *batch.columns], ["block", "vec_id", "embedding", "cell"])

    held = entries.mapInArrow(dealt, "block long, vec_id long, embedding array<double>, cell long").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_parts - 1).cast("long"))))

    def rerank(asked: pa.Table, held: pa.Table) -> pa.Table:
        one, out = full.value, ([], [], [])
        if asked.num_rows and held.num_rows:
            q, x = matrix(asked.column("query").combine_chunks()), matrix(held.column("embedding").combine_chunks())
            vec, qid = held.column("vec_id").to_numpy(), asked.column("query_id").to_numpy()
            cell, reach = held.column("cell").to_numpy(), asked.column("reach").to_numpy()
            long_q, long_x = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1))
            a, b = one.distances(unit(q))
            i, j = np.divmod(cell, len(one.right))
            for lo in range(0, len(q), 256):
                near = (q[lo : lo + 256] @ x.T) / long_q[lo : lo + 256, None] / long_x
                for r in range(near.shape[0]):
                    open_ = np.flatnonzero((a[lo + r][i] + b[lo + r][j] <= reach[lo + r] + 1e-12) & (vec != qid[lo + r]))
                    if not len(open_):
                        continue
                    some = near[r, open_]
                    floor = np.partition(some, len(some) - k)[len(some) - k] - 1e-9 if len(some) > k else -2.0
                    best = open_[some >= floor]
                    exact = (x[best] * q[lo + r]).sum(1) / (long_x[best] * long_q[lo + r])
                    for t in np.lexsort((vec[best], -exact))[:k].tolist():
                        for column, v in zip(out, (int(qid[lo + r]), int(vec[best[t]]), float(exact[t])), strict=True):
                            column.append(v)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    found = sent.groupBy("block", "part").cogroup(held.groupBy("block", "part")).applyInArrow(rerank, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # a repeated row counts once
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
