"""Runs of documents are dealt to rows and lines without a join, so that no group of theirs goes through the driver."""

from __future__ import annotations

from collegium.operators import documents


def test_lines_of_runs_join_nothing(spark):
    cells = [(d, 1, t, float(x), float(y), 30.0, 10.0) for d in range(3) for t, x, y in (("a", 10, 700), ("b", 100, 699), ("c", 100, 688), ("d", 10, 660), (" ", 50, 660))]
    cells.append((None, 1, "lost", 10.0, 700.0, 30.0, 10.0))
    runs = spark.createDataFrame(cells, "doc long, page int, text string, x double, y double, width double, height double")
    found = documents.lines_of_runs(runs)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.doc, r.line, r.text, r.y, r.runs) for r in found.collect())
    assert got == sorted((d, n, t, y, k) for d in range(3) for n, t, y, k in ((0, "a b c", 700.0, 3), (1, "d", 660.0, 1)))
