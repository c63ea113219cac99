"""Rows that break no check are left out before a join, and duplicates are grouped by numbers as they are."""

from __future__ import annotations

from pyspark.sql import functions as F

from collegium.operators import quality as Q


def test_rows_are_filtered_before_the_join(spark):
    lines = spark.createDataFrame([(1, 3), (2, None), (2, 9), (3, 4)], "k long, n int")
    owners = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, who string")
    found = Q.violations(lines.join(owners, "k"), {"small": (F.col("n") < 4, F.col("who")), "large": (F.col("n") > 8, F.col("who"))})
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "< 4" in plan[plan.index("Join") :] and "> 8" in plan[plan.index("Join") :]
    assert sorted(map(tuple, found.collect())) == [("large", "b"), ("small", "a")]


def test_duplicates_of_numbers_texts_and_nulls(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "a"), (2, None), (2, ""), (3, None)]
    found = Q.duplicates(spark.createDataFrame(rows, "k long, t string"), "twice", ["k", "t"])
    assert "cast(k" not in found._jdf.queryExecution().analyzed().toString().split("Aggregate")[1]
    assert sorted(map(tuple, found.collect())) == [("twice", "1|a"), ("twice", "2|"), ("twice", "|a")]


def test_report_sorts_violations_once(spark):
    found = spark.createDataFrame([("a", f"{n:02d}") for n in range(40)] + [("a", "07"), ("b", "x")], "check string, what string")
    report = Q.report(["a", "b", "c"], [found], salts=3)
    assert report._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 2
    assert sorted(map(tuple, report.collect())) == [("a", 41, False, "00, 01, 02, 03, 04"), ("b", 1, False, "x"), ("c", 0, True, "")]
