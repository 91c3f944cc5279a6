"""Operator 7: embedding near-dedup by a PCA-ordered tiled comparison.

Equal vectors become one with a multiplicity. Unit vectors are rotated onto the principal axes (covariance summed over all
rows), so that their leading dimensions hold most of what can differ, and laid out in tiles along the first axis. A task
compares two tiles: it adds up products of leading dimensions in steps, bounds what the others can add by the product of the
suffix norms, and drops a pair as soon as its cosine cannot reach the threshold. What is left is decided by the cosine of
the original vectors in doubles. Tile pairs whose bounding boxes on the leading axes are too far apart never meet.

Tasks send counts per vector and a spanning forest of the links they find, never all links. The number of tile pairs grows
with the square of the vectors: each has to be held against each. Tiles are cut by size, so a dense spot is many tiles.

Defined cases: see ``vectors.by_length`` for the rows that take part, each among those of its length; the others are returned with no links, themselves as
component and kept (a null vec_id: null component, not kept); rows that repeat a vec_id with its vector link with each
other and share their component; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import Shipped, stored
from curatrix.llm.components import components
from curatrix.llm.vectors import by_length, matrix, unit, usable

THRESHOLD = 0.9
TILE = 4096
BOX = 8  # leading axes with bounds per tile
STEPS = (16, 32)


def principal_axes(rows: DataFrame) -> np.ndarray:
    """Columns are the axes by falling variance of the unit vectors; what leaves Spark is one d x d sum per task."""

    def summed(batches):
        total = None
        for batch in batches:
            x = unit(matrix(batch.column("embedding")))
            if len(x):
                part = np.vstack([x.T @ x, x.sum(0), np.full(x.shape[1], float(len(x)))])
                total = part if total is None else total + part
        if total is not None:
            d = total.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel()), pa.array(np.full(total.size, d))], ["at", "v", "d"])

    cells = rows.mapInArrow(summed, "at long, v double, d long").groupBy("at", "d").agg(F.sum("v").alias("v")).collect()
    d = int(cells[0]["d"])
    total = np.zeros((d + 2) * d)
    for c in cells:
        total[c["at"]] = c["v"]
    total = total.reshape(-1, d)
    n = total[d + 1, 0]
    mean = total[d] / n
    _, axes = np.linalg.eigh(total[:d] / n - np.outer(mean, mean))
    return axes[:, ::-1]


class Forest:
    """Union of numbers 0..n-1; remembers the links that joined something."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = int(self.up[x])
        return x

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        open_ = self.up[i] != self.up[j]
        if not open_.any():
            return
        for a, b in zip(i[open_].tolist(), j[open_].tolist(), strict=True):
            x, y = self.find(a), self.find(b)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                self.links.append((a, b))
        flat = self.up[self.up]
        while (flat != self.up).any():
            self.up, flat = flat, flat[flat]


def linked(x: np.ndarray, y: np.ndarray, rx: np.ndarray, ry: np.ndarray, threshold: float, same: bool, strip: int = 64):
    """Pairs (i, j) of rows with cosine >= threshold, strip by strip; ``rx`` and ``ry`` are the rotated unit vectors."""
    d = rx.shape[1]
    steps = [s for s in STEPS if s < d]
    tails = [(np.sqrt((rx[:, s:] ** 2).sum(1)), np.sqrt((ry[:, s:] ** 2).sum(1))) for s in steps]
    long_x, long_y = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
    slack = threshold - 1e-9
    for lo in range(0, len(x), strip):
        hi = min(lo + strip, len(x))
        part = rx[lo:hi, : steps[0]] @ ry[:, : steps[0]].T if steps else np.ones((hi - lo, len(y)))
        alive = part + tails[0][0][lo:hi, None] * tails[0][1] >= slack if steps else part > 0
        if same:
            alive &= np.arange(len(y)) > np.arange(lo, hi)[:, None]
        i, j = np.nonzero(alive)
        part = part[i, j]
        for a, s in enumerate(steps[1:], 1):
            if not len(i):
                break
            before = steps[a - 1]
            part = part + np.einsum("nd,nd->n", rx[lo + i, before:s], ry[j, before:s])
            keep = part + tails[a][0][lo + i] * tails[a][1][j] >= slack
            i, j, part = i[keep], j[keep], part[keep]
        if len(i):
            exact = np.einsum("nd,nd->n", x[lo + i], y[j]) / (long_x[lo + i] * long_y[j])
            keep = exact >= threshold
            if keep.any():
                yield lo + i[keep], j[keep]


def _tile_rows(axes, edges, parts):
    """Rows of a task, dealt to their tiles, as blobs."""

    def run(batches):
        turn, cuts, split = axes.value, edges.value, parts.value
        held: dict[int, list] = {}
        for batch in batches:
            x = matrix(batch.column("embedding"))
            if not len(x):
                continue
            ids, times = batch.column("node").to_numpy(), batch.column("copies").to_numpy()
            lead = (unit(x) @ turn[:, :1])[:, 0]
            bucket = np.searchsorted(cuts, lead, "right")
            tile = split[0][bucket] + (ids * np.int64(2654435761) >> np.int64(7)) % split[1][bucket]
            for t in np.unique(tile).tolist():
                at = tile == t
                held.setdefault(t, []).append((ids[at], times[at], x[at]))
        for t, found in held.items():
            ids, times, x = (np.concatenate(c) for c in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([times.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["tile", "ids", "times", "x"])

    return run


def _one_tile(axes):
    def run(group: pa.Table) -> pa.Table:
        turn = axes.value
        ids, times, x = (b"".join(group.column(c).to_pylist()) for c in ("ids", "times", "x"))
        lead = unit(np.frombuffer(x).reshape(-1, len(turn))) @ turn[:, :BOX]
        return pa.table({
            "tile": group.column("tile").slice(0, 1), "ids": pa.array([ids], pa.binary()), "times": pa.array([times], pa.binary()), "x": pa.array([x], pa.binary()),
            "low": pa.array([lead.min(0).tolist()], pa.list_(pa.float64())), "high": pa.array([lead.max(0).tolist()], pa.list_(pa.float64())),
        })

    return run


def _pair_batches(axes, threshold: float):
    def run(batches):
        turn = axes.value
        for batch in batches:
            for row in batch.to_pylist():
                same = row["tile"] == row["other"]
                x, y = (np.frombuffer(row[c]).reshape(-1, len(turn)) for c in ("x", "y"))
                a, b = (np.frombuffer(row[c], np.int64) for c in ("ids", "ids_y"))
                m, n = (np.frombuffer(row[c], np.int64) for c in ("times", "times_y"))
                nx, ny = np.zeros(len(x)), np.zeros(len(y))
                forest = Forest(len(x) if same else len(x) + len(y))
                for i, j in linked(x, y, unit(x) @ turn, unit(y) @ turn, threshold, same):
                    nx += np.bincount(i, n[j], len(x))
                    ny += np.bincount(j, m[i], len(y))
                    forest.add(i, j if same else j + len(x))
                ids = np.concatenate([a, b]) if not same else a
                links = np.array(forest.links, np.int64).reshape(-1, 2)
                count = np.concatenate([nx, ny]) if not same else nx + ny
                some = count > 0
                k = int(some.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([ids[some], ids[links[:, 0]]])), pa.array(np.concatenate([np.full(k, -1), ids[links[:, 1]]])), pa.array(np.concatenate([count[some].astype(np.int64), np.zeros(len(links), np.int64)]))],
                    ["node", "to", "n"],
                )

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors``."""
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rest = every.where(~(usable() & F.col("vec_id").isNotNull()))
    single = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), (F.col("vec_id") + 0).alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    return reduce(DataFrame.union, [_linked(rows, threshold) for rows in by_length(every)], single)


def _linked(vectors: DataFrame, threshold: float) -> DataFrame:
    """The same for usable vectors of one length."""
    spark = vectors.sparkSession
    rows = vectors.withColumn("embedding", F.transform(F.col("embedding").cast("array<double>"), lambda x: x + 0.0))  # one zero
    rows = rows.withColumns({"h": F.xxhash64("embedding"), "g": F.xxhash64(F.lit(1), "embedding")})  # equal vectors, by 128 bits
    nodes = stored(rows.groupBy("h", "g").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")), "vectors")
    total = nodes.count()
    turn = principal_axes(nodes)
    axes = Shipped(spark, turn)

    # edges of about equal numbers along the first axis, then tiles of bounded size
    buckets = max(1, -(-total // TILE))
    lead = nodes.withColumn("lead", F.aggregate(F.zip_with("embedding", F.array(*[F.lit(float(v)) for v in turn[:, 0]]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) / F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v)))
    marks = lead.agg(F.percentile_approx("lead", [j / buckets for j in range(1, buckets)], 10_000)).first()[0] if buckets > 1 else []
    cuts = np.array(sorted(set(marks)), np.float64)
    edges = Shipped(spark, cuts)

    def tally(batches):
        where, t = edges.value, axes.value
        n = np.zeros(len(where) + 1, np.int64)
        for batch in batches:
            x = matrix(batch.column("embedding"))
            if len(x):
                n += np.bincount(np.searchsorted(where, (unit(x) @ t[:, :1])[:, 0], "right"), minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], ["bucket", "n"])

    size = np.zeros(len(cuts) + 1, np.int64)
    for r in nodes.select("embedding").mapInArrow(tally, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        size[r["bucket"]] = r["n"]
    split = np.maximum(1, -(-size // (TILE + TILE // 4)))
    parts = Shipped(spark, (np.cumsum(split) - split, split))

    dealt = nodes.mapInArrow(_tile_rows(axes, edges, parts), "tile long, ids binary, times binary, x binary")
    tiles = stored(dealt.groupBy("tile").applyInArrow(_one_tile(axes), "tile long, ids binary, times binary, x binary, low array<double>, high array<double>"), "tiles")
    boxes = tiles.select("tile", "low", "high").collect()  # one small row per tile
    most = 2 - 2 * threshold + 1e-9  # squared distance of unit vectors
    low, high = (np.array([r[c] for r in boxes]) for c in ("low", "high"))
    number = [r["tile"] for r in boxes]
    meet = []
    for i in range(len(number)):
        gap = np.maximum(0, np.maximum(low[i:] - high[i], low[i] - high[i:]))
        meet += [(number[i], number[i + int(j)]) for j in np.flatnonzero((gap**2).sum(1) <= most)]
    pairs = spark.createDataFrame(meet, "tile long, other long").repartition(max(1, len(meet)))
    left = tiles.select("tile", "ids", "times", "x")
    right = tiles.select(F.col("tile").alias("other"), F.col("ids").alias("ids_y"), F.col("times").alias("times_y"), F.col("x").alias("y"))
    found = stored(pairs.join(left, "tile").join(right, "other").mapInArrow(_pair_batches(axes, threshold), "node long, to long, n long"), "vector-links")

    label = components(found.where(F.col("to") >= 0), "node", "to")
    counts = found.where(F.col("to") < 0).groupBy("node").agg(F.sum("n").alias("n"))
    known = nodes.join(counts, "node", "left").join(label, "node", "left").select("h", "g", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    known = stored(known, "vector-classes")
    return rows.select("vec_id", "h", "g").join(known, ["h", "g"]).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
