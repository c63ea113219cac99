"""Exact dedup against grouping in plain Python."""

from __future__ import annotations

import hashlib
import random

import pytest

from collegium.llm.exact_dedup import exact_dedup

SCHEMA = "doc_id long, text string, digest string, head string, group_size string, keep_id string"


def plain(rows: list[tuple]) -> list[tuple]:
    groups: dict[str, list] = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for doc_id, text in rows:
        same = groups[text or ""]
        known = [x for x in same if x is not None]
        keep = max(known) if known else None
        out.append((doc_id, keep, len(same), doc_id == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows: list[tuple], **options) -> list[tuple]:
    # Extra columns carry the names that the operator uses itself.
    docs = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)
    out = exact_dedup(docs, **options)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_odd_rows(spark):
    start = "same start " * 40  # longer than the prefix that the second pass hashes
    rows = [(1, None), (2, ""), (3, "a"), (4, "A"), (5, "a "), (6, start + "x"), (7, start + "y"), (8, start + "x"), (9, "ü"), (10, "ü"), (None, "a"), (None, "z"), (None, "z"), (11, "x" * 300_000), (12, "x" * 300_000), (13, "x" * 299_999 + "y"), (14, "twice"), (14, "twice")]
    assert found(spark, rows) == plain(rows)


@pytest.mark.parametrize("map_longs", [1 << 19, 16, 1])
def test_random_rows_by_maps_of_all_sizes(spark, map_longs):
    pick = random.Random(3)
    rows = [(i, pick.choice(["ab", "ba", "abc", "", None, "hot", "hot", "hot"]) if pick.random() < 0.7 else f"text {i // 2}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from collegium.llm.exact_dedup import exact_groups

    groups = {r.digest: (r.keep_id, r.group_size) for r in exact_groups(docs, prefix=2, map_longs=map_longs).collect()}
    want = {bytes.fromhex(sha): (keep, size) for _, keep, size, _, sha in plain(rows) if size > 1}
    assert {bytes(k): v for k, v in groups.items()} == want


def test_no_rows(spark):
    assert found(spark, []) == []
