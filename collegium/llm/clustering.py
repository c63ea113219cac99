"""Centroid clustering: exact whole-number rounds with partial-distance search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collegium.llm.common import materialise, slices
from collegium.llm.vectors import exact, finite, largest, whole

#: Components of a vector, and what they are multiplied by.
DIMS, SCALE = 64, 256
#: Centroids and rounds.
CENTROIDS, ROUNDS = 40, 5
#: Dimensions that are added between two looks at which centroids are out of reach.
STEP = 8
#: Vectors that a task looks at together.
ROWS = 4096


@dataclass
class Centroids:
    """Whole-number centroids, and the dimensions in descending order of variance."""

    points: np.ndarray
    order: np.ndarray


def nearest(vectors: np.ndarray, centroids: Centroids, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each vector's nearest centroid; of those equally near, the smallest number.

    Differences are added over `step` dimensions at a time, those of high variance first. The centroid that leads after
    the first dimensions is measured in full; the others go on until they are strictly farther, so that equally near
    ones finish all dimensions.
    """
    dims, n = vectors.shape[1], len(vectors)
    bound = dims * (largest(vectors) + largest(centroids.points)) ** 2
    rows, points = exact(bound, vectors[:, centroids.order], centroids.points[:, centroids.order])
    square = lambda a, b, lo, hi: ((a[:, lo:hi] - b[:, lo:hi]) ** 2).sum(axis=1)
    start = np.stack([((rows[:, :step] - p[:step]) ** 2).sum(axis=1) for p in points], axis=1)
    leader = start.argmin(axis=1) if start.dtype != object else np.array([min(range(len(points)), key=row.__getitem__) for row in start], np.int64)
    at = np.arange(n)
    best = start[at, leader] + square(rows, points[leader], step, dims)
    row, number = np.nonzero(start <= best[:, None])
    so_far = start[row, number]
    for lo in range(step, dims, step):
        so_far = so_far + square(rows[row], points[number], lo, lo + step)
        going = so_far <= best[row]
        row, number, so_far = row[going], number[going], so_far[going]
    # What is left has its full distance; the least, then the smallest number, comes first in each vector's run.
    order = np.lexsort((number, so_far, row)) if so_far.dtype != object else np.array(sorted(range(len(row)), key=lambda i: (row[i], so_far[i], number[i])), np.int64)
    first = order[np.searchsorted(row[order], at)]
    return number[first], so_far[first].astype(object if so_far.dtype == object else np.int64)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in slices(batches, ROWS):
        if batch.num_rows:
            yield batch, whole(batch.column("vector"), SCALE, DIMS)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """dim, n, total, squares of a task's vectors, for the variances that order dimensions."""
    n, total, squares = 0, np.zeros(DIMS), np.zeros(DIMS)
    for _, found in _vectors(batches):
        found = found.astype(np.float64)
        n, total, squares = n + len(found), total + found.sum(axis=0), squares + (found**2).sum(axis=0)
    yield pa.RecordBatch.from_pydict({"dim": np.arange(DIMS, dtype=np.int32), "n": np.full(DIMS, n, np.int64), "total": total, "squares": squares})


def _sums(centroids: Centroids):
    """cluster, dim, total, n of a task's vectors, added up before any shuffle; totals as decimal text, as they may be of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids.points)
        totals, counts = np.zeros((k, DIMS), object), np.zeros(k, np.int64)
        for _, found in _vectors(batches):
            number, _ = nearest(found, centroids)
            counts += np.bincount(number, minlength=k)
            if found.dtype != object and largest(found) < 1 << 40:  # 4,096 of them fit a 64-bit sum
                order = np.argsort(number, kind="stable")
                there = np.flatnonzero(np.bincount(number, minlength=k))
                part = np.add.reduceat(found[order], np.searchsorted(number[order], there), axis=0)
                totals[there] += part.astype(object)
            else:
                for i, row in zip(number, found.astype(object)):
                    totals[i] += row
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({
            "cluster": np.repeat(held, DIMS).astype(np.int32),
            "dim": np.tile(np.arange(DIMS, dtype=np.int32), len(held)),
            "total": pa.array([str(x) for x in totals[held].ravel()], pa.string()),
            "n": np.repeat(counts[held], DIMS),
        })

    return run


def _assigned(centroids: Centroids):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _vectors(batches):
            number, distance = nearest(found, centroids)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(number, pa.int32()), pa.array(distance, pa.int64())], names=["id", "cluster", "distance"])

    return run


def starting(rows: DataFrame, k: int = CENTROIDS) -> np.ndarray:
    """The k vectors whose ids' hashes are least, in the order of these; k rows reach the driver."""
    tag = F.sha2(F.concat(F.lit("2:"), F.col("id").cast("string")), 256)
    first = rows.orderBy(tag.asc_nulls_last(), F.col("vector")).limit(k)
    batches = [b for b in first.select("vector").toArrow().combine_chunks().to_batches() if b.num_rows]
    found = [whole(b.column("vector"), SCALE, DIMS) for b in batches]
    return np.concatenate(found) if found else np.zeros((0, DIMS), np.int64)


def by_variance(rows: DataFrame) -> np.ndarray:
    found = rows.mapInArrow(_spread, "dim int, n long, total double, squares double").groupBy("dim").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")]).collect()
    variance = np.zeros(DIMS)
    for r in found:
        variance[r.dim] = r.squares / max(1, r.n) - (r.total / max(1, r.n)) ** 2
    return np.argsort(-variance, kind="stable")


def moved(rows: DataFrame, centroids: Centroids) -> np.ndarray:
    """The centroids after a round: the floor of each component's exact mean; those without vectors stay."""
    part = rows.mapInArrow(_sums(centroids), "cluster int, dim int, total string, n long")
    found = part.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total"), F.sum("n").alias("n"))
    points = centroids.points.astype(object)
    for r in found.collect():  # a row for each centroid and dimension
        points[r.cluster, r.dim] = int(r.total) // r.n
    return points.astype(np.int64) if largest(points) < 1 << 62 else points


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """One row per kept vector: its id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of 64 components, none null or non-finite; each component x becomes floor(256 x). The k vectors
    with the least SHA-256 of '2:<id>' start as centroids 0, 1, ... (rows with a null id last, rows of one id in the
    order of their vectors; fewer than k vectors make fewer centroids). Rows that repeat an id or a vector count as
    often as they stand there. No kept vector, or an empty table, gives no rows; other columns are ignored. A distance
    or sum of distances that a long can't hold is an error.

    A round reads the table once: tasks add up what they assign, so that k x 64 sums of each task are shuffled, and
    k x 64 numbers reach the driver, whatever the table's size and however many vectors are alike.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    rows = rows.where((F.size("vector") == DIMS) & finite(F.col("vector")))
    centroids = Centroids(starting(rows, k), by_variance(rows))
    if not len(centroids.points):
        centroids = Centroids(np.zeros((1, DIMS), np.int64), centroids.order)
    for _ in range(rounds):
        centroids = Centroids(moved(rows, centroids), centroids.order)
    found = materialise(rows.mapInArrow(_assigned(centroids), "id long, cluster int, distance long"), "clusters")
    inertia = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    told = [(i, inertia.get(i, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, p)).encode()).hexdigest()) for i, p in enumerate(centroids.points)]
    names = found.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(names), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
