"""Schemes are read by batches of documents, and totals found without a join."""

from __future__ import annotations

from collegium.functions import timetables
from collegium.operators import schemes

RUN = "doc long, page int, text string, x double, y double, width double, height double"


def test_documents_come_by_the_batch(spark):
    cells = [(d, 1, t, float(x), float(y), 40.0, 10.0) for d in range(3) for t, x, y in [("V SEMESTER", 100, 740), ("BCS301", 50, 700), ("Graph Theory", 110, 700), ("BCS302", 50, 600), (" ", 1, 1), *[(n, 300 + 30 * i, 700) for i, n in enumerate("3005012")]]]
    found = schemes.scheme_rows(spark.createDataFrame(cells, RUN))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan
    assert sorted((r.doc, r.code, r.credits, r.reason) for r in found.collect()) == sorted(row for d in range(3) for row in ((d, "BCS301", 2, None), (d, "BCS302", None, "elective_option")))


def test_totals_join_nothing(spark):
    cells = [(1, 1, "III SEMESTER", 9.0, 700.0), (1, 1, "TOTAL", 1.0, 300.0), (1, 1, "22", 9.0, 300.2), (1, 2, "Total 1", 1.0, 300.0), (1, 2, "20", 9.0, 300.0), (1, 2, "99", 5.0, 300.0), (2, 1, "TOTAL", 1.0, 300.0), (2, 1, "22", 9.0, 300.0), (1, 3, None, 0.0, 300.0), (1, 4, "TOTAL", 1.0, 300.0), (1, 4, "40", 9.0, 300.0)]
    found = timetables.printed_totals(spark.createDataFrame(cells, "doc long, page int, text string, x double, y double"))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(1, 1, 3, 22), (1, 2, 3, 20)]
