"""Suffix-array dedup against a count of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from collegium.llm.suffix_dedup import Anchors, sliding_least, suffix_report


def expected(rows, window):
    raws = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(r[p : p + window] for _, r in raws for p in range(len(r) - window + 1))
    out = []
    for i, r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for p in range(len(r) - window + 1):
            if count[r[p : p + window]] > 1:
                gone[p : p + window] = True
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(r) else 0
        kept = bytes(c for c, g in zip(r, gone) if not g)
        out.append((i, len(r), len(r) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1, "h") for r in rows], "doc_id long, text string, lo int, anchor_hash string")
    rows = suffix_report(docs, **options).collect()
    assert all(r.repeated == (r.n_removed > 0) and r.kept_share == ((r.n_bytes - r.n_removed) / r.n_bytes if r.n_bytes else 1) for r in rows)
    return sorted((tuple(r)[:5] for r in rows), key=str)


@pytest.mark.parametrize("letters", ["ab", "abcdefghijklmnop"])
def test_random_texts_with_shared_parts(spark, letters):
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    parts = [text(rng.randint(10, 90)) for _ in range(12)]
    rows = []
    for i in range(60):
        body = "".join(rng.choice([rng.choice(parts), text(rng.randint(0, 30))]) for _ in range(rng.randint(0, 8)))
        rows.append((i, body))
    rows += [(100, rows[3][1]), (101, None), (102, "é" * 40), (103, "a" * 300), (104, rows[5][1][1:]), (None, rows[6][1]), (None, None)]
    for window, gram, size in ((40, 12, 4), (25, 10, 16), (12, 12, 3)):
        assert found(spark, rows, window=window, gram=gram, size=size) == expected(rows, window)


def test_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(900, rows[0][1] + rows[1][1]), (901, rows[2][1][:399]), (902, rows[2][1][5:405])]
    assert found(spark, rows) == expected(rows, 400)


def test_repeated_rows_and_no_rows(spark):
    rows = [(1, "x" * 10 + "y" * 500), (1, "x" * 10 + "y" * 500), (1, "other " * 100), (2, "short")]
    assert found(spark, rows) == expected(rows, 400)
    assert found(spark, [])[:1] == []


def test_long_texts_are_taken_in_parts():
    rng = np.random.default_rng(8)
    raw = rng.integers(97, 100, 5000, dtype=np.uint8).tobytes()
    whole, parts = Anchors(40, 12), Anchors(40, 12, part=700)
    a, b = whole.ranges(raw), parts.ranges(raw)
    for x in (a, b):
        assert x[2][0] == 0 and x[3][-1] == len(raw) - 40 and (x[2][1:] == x[3][:-1] + 1).all()
    at = lambda r: np.repeat(r[1], r[3] - r[2] + 1)
    assert (at(a) == at(b)).all()


def test_sliding_least():
    values = np.random.default_rng(9).integers(0, 1000, 101, dtype=np.uint64)
    assert all(sliding_least(values, s).tolist() == [values[i : i + s].min() for i in range(len(values) - s + 1)] for s in (1, 2, 7, 101))
