"""Exact top-k search against all products in plain Python."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from collegium.llm.topk import bulk_load, top_scores

SCHEMA = "vec_id long, embedding array<double>, row string, id string, vector string, route string, score string"


def plain(rows: list[tuple], every: int, k: int) -> list[tuple]:
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(kept):
        if q is not None and q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i is None, i or 0) for other, (i, w) in enumerate(kept) if other != at)
            out += [(q, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(scores[:k], 1)]
    return sorted(out, key=repr)


def found(spark, rows: list[tuple], **options) -> list[tuple]:
    vectors = spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], SCHEMA)  # clashing names
    out = top_scores(vectors, **options)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def near(pick: random.Random, centre: list[float]) -> list[float]:
    return [x + pick.gauss(0, 0.1) for x in centre]


@pytest.mark.parametrize("sizes", [{}, {"page": 8, "tree": 40, "block": 5, "each": 50}])
def test_clusters_ties_and_odd_rows(spark, sizes):
    """Once with the sizes as they are, once so small that pages, trees, blocks and routing objects are many."""
    pick = random.Random(21)
    centres = [[pick.gauss(0, 1) for _ in range(64)] for _ in range(6)]
    rows = [(i, near(pick, pick.choice(centres))) for i in range(250)] + [(-20, centres[0]), (-40, centres[1])]
    rows += [(1000 + i, centres[2]) for i in range(70)]  # one vector of many rows: ties by id
    rows += [(20, centres[0]), (20, centres[0]), (None, centres[0]), (None, centres[2])]
    rows += [(2000, None), (2020, [*centres[0][:63], None]), (2040, [math.nan] * 64), (2060, [math.inf, *centres[0][1:]]), (2080, []), (2100, centres[0][:10]), (2120, [0.0] * 64)]
    assert found(spark, rows, **sizes) == plain(rows, 20, 20)


def test_large_components_and_a_query_with_few_others(spark):
    pick = random.Random(22)
    rows = [(20 * i, [pick.gauss(0, 1) * 10.0**e for _ in range(8)]) for i, e in enumerate([0, 3, 6, 6, 0])]
    assert found(spark, rows) == plain(rows, 20, 20)
    assert found(spark, [(0, [1.0])]) == [] and found(spark, []) == []
    assert found(spark, [(1, [1.0]), (2, [2.0])]) == []


def test_pages_hold_each_entry_once_within_their_radius():
    made = np.random.default_rng(3)
    vectors = np.concatenate([made.integers(-50, 50, (300, 16)), np.tile(made.integers(-50, 50, (1, 16)), (200, 1))])
    pages = bulk_load(vectors, vectors[0], 32)
    assert sorted(np.concatenate([own for *_, own, _ in pages]).tolist()) == list(range(500))
    for centre, radius, to_parent, own, far in pages:
        true = np.sqrt(((vectors[own] - vectors[centre]) ** 2).sum(axis=1))
        assert len(own) <= 32 and np.allclose(far, true) and radius == far[0] == far.max()
        assert math.isclose(to_parent, math.dist(vectors[centre], vectors[0]))
