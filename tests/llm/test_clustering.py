"""Centroid clustering against plain whole-number rounds in Python."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from collegium.llm.clustering import Centroids, cluster, nearest

SCHEMA = "vec_id long, embedding array<double>, label string, id string, vector string, cluster string, distance string"


def plain(rows: list[tuple], k: int, rounds: int) -> list[tuple]:
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    by_hash = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    points = [v for _, v in by_hash[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [min((square(v, p), c) for c, p in enumerate(points)) for _, v in kept]

    for _ in range(rounds):
        own = assign()
        for c in range(len(points)):
            members = [v for (_, v), (_, at) in zip(kept, own) if at == c]
            if members:
                points[c] = [sum(column) // len(members) for column in zip(*members)]
    own = assign()
    names = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    inertia = [sum(d for d, at in own if at == c) for c in range(len(points))]
    return sorted(((i, c, d, inertia[c], sum(inertia), names[c]) for (i, _), (d, c) in zip(kept, own)), key=repr)


def found(spark, rows: list[tuple], **options) -> list[tuple]:
    vectors = spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], SCHEMA)  # clashing names
    out = cluster(vectors, **options)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def vector(pick: random.Random, spread: float = 1.0) -> list[float]:
    return [pick.gauss(0, spread) for _ in range(64)]


def test_odd_rows_ties_and_a_hot_vector(spark):
    pick = random.Random(5)
    hot, pair = vector(pick), vector(pick)
    rows = [(i, hot) for i in range(40)] + [(100 + i, vector(pick)) for i in range(60)] + [(200, pair), (200, pair), (200, hot), (None, pair), (None, vector(pick))]
    rows += [(300, None), (301, []), (302, pair[:63]), (303, [*pair[:63], None]), (304, [*pair[:63], math.nan]), (305, [math.inf, *pair[1:]]), (306, [*pair, 1.0])]
    assert found(spark, rows, k=7, rounds=3) == plain(rows, 7, 3)


def test_whole_numbers_beyond_floating_point(spark):
    pick = random.Random(6)
    rows = [(i, vector(pick, 10.0**4)) for i in range(25)] + [(50 + i, [x * 300 for x in vector(pick, 10.0**3)]) for i in range(25)]
    assert found(spark, rows, k=4, rounds=2) == plain(rows, 4, 2)


def test_fewer_vectors_than_centroids_and_no_rows(spark):
    pick = random.Random(7)
    rows = [(i, vector(pick)) for i in range(3)]
    assert found(spark, rows) == plain(rows, 40, 5)
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, [0.5])]) == []


@pytest.mark.parametrize("most", [2, 1000, 1 << 30, 1 << 40])
def test_nearest_is_that_of_all_distances(most):
    made = np.random.default_rng(most % 97)
    vectors, points = made.integers(-most, most, (200, 64)), made.integers(-most, most, (9, 64))
    vectors[:20], points[5] = points[3], points[3]  # equally near, by a distance of nothing
    number, distance = nearest(vectors, Centroids(points, made.permutation(64)))
    every = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, p)) for p in points] for v in vectors]
    assert [(int(d), int(c)) for c, d in zip(number, distance)] == [min((d, c) for c, d in enumerate(row)) for row in every]
