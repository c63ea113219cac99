"""Rule arithmetic at its edges, and properties that must hold for any marks."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from collegium.functions import rules as R

QUICK = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def column(spark, values, kind, f):
    values = [float(v) if kind == "double" and v is not None else v for v in values]
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(f(F.col("x"))).collect()]


def test_half_up(spark):
    values = [1.005, -1.005, 2.675, 0.0, -0.0, 7.994999, 1e-12, None, 8.045]
    assert column(spark, values, "double", R.half_up) == [1.01, -1.01, 2.68, 0.0, 0.0, 7.99, 0.0, None, 8.05]


@pytest.mark.parametrize(("total", "letter"), [(100, "O"), (90, "O"), (89, "A+"), (79.6, "A"), (70, "A"), (69, "B+"), (59, "B"), (54, "C"), (49, "P"), (40, "P"), (39.99, "F"), (0, "F"), (-1, None), (101, None), (None, None)])
def test_grade_of_marks(spark, total, letter):
    assert column(spark, [total], "double", R.grade_of_marks) == [letter]


def test_letters(spark):
    letters = [" a+ ", "dx", "AB", "Z", None]
    assert column(spark, letters, "string", R.points_of) == [9, 0, None, None, None]
    assert column(spark, letters, "string", R.counts_in_average) == [True, False, None, None, None]
    assert column(spark, letters, "string", R.grade_refusal) == [None, None, "unverified_grade", "unknown_grade", "unknown_grade"]


def test_golden_card(spark):
    """The nine rows of the synthetic grade card: marks, kind of course, letter."""
    rows = [(38, 21, True, "B"), (40, 23, True, "B+"), (46, 20, True, "B+"), (41, 30, True, "A"), (45, 34, True, "A"), (46, 34, True, "A+"), (47, 41, True, "A+"), (44, 48, True, "O"), (72, 0, False, "A")]
    df = spark.createDataFrame([("BXXX401", i, e, i + e, s, g) for i, e, s, g in rows], "code string, internal int, external int, total int, see boolean, letter string")
    heads = R.heads(F.col("internal"), F.col("external"), F.col("total"), F.col("see"))
    found = df.select("letter", R.grade_of_marks(F.col("total")).alias("own"), heads["passed"].alias("passed"), R.marks_refusal(F.col("code"), F.col("internal"), F.col("external"), F.col("total"), F.col("see")).alias("no")).collect()
    assert all(r.passed and r.no is None and r.own == r.letter for r in found)


def test_marks_refusals(spark):
    rows = [("1X", 30, 30, 60, True, "invalid_code"), ("X1", None, 30, 60, True, "missing_marks"), ("X1", 51, 0, 51, True, "internal_out_of_range"), ("X1", 60, 1, 61, False, "external_without_see"), ("X1", 30, 51, 81, True, "external_out_of_range"), ("X1", 30, 30, 61, True, "total_disagrees"), ("X1", 100, 0, 100, False, None)]
    df = spark.createDataFrame(rows, "c string, i int, e int, t int, s boolean, want string")
    assert all(r.want == r.got for r in df.select("want", R.marks_refusal(F.col("c"), F.col("i"), F.col("e"), F.col("t"), F.col("s")).alias("got")).collect())


def test_classes(spark):
    assert column(spark, [100.0, 70.0, 69.99, 60.0, 50.0, 49.99, 40.0, 39.99, None], "double", R.class_of) == ["FCD", "FCD", "FC", "FC", "SC", "P", "P", "none", None]


@QUICK
@given(st.lists(st.tuples(st.integers(0, 200), st.integers(1, 200)), min_size=1, max_size=40))
def test_attendance_plans_hold(spark, counts):
    """Attending what must be attended reaches the requirement; missing one more than may be missed falls below it."""
    rows = [(min(a, c), c) for a, c in counts]
    df = spark.createDataFrame(rows, "a bigint, c bigint")
    for a, c, miss, must in df.select("a", "c", R.can_miss(F.col("a"), F.col("c")), R.must_attend(F.col("a"), F.col("c"))).collect():
        assert (a + must) / (c + must) * 100 >= 85 - 1e-9
        assert must == 0 or (a + must - 1) / (c + must - 1) * 100 < 85
        assert a / (c + miss) * 100 >= 85 - 1e-9 or miss == 0
        assert a / (c + miss + 1) * 100 < 85 + 1e-9


@QUICK
@given(st.lists(st.tuples(st.integers(1, 6), st.sampled_from([b[0] for b in R.BANDS])), min_size=1, max_size=12))
def test_average_properties(spark, courses):
    """Within 0 and the highest point; unchanged when credits double; never raised by a failed course."""
    from collegium.plans.grading import weighted_mean

    points = {b[0]: b[1] for b in R.BANDS}
    mean = lambda rows: spark.createDataFrame(rows, "c bigint, p bigint").agg(R.half_up(weighted_mean(F.col("c"), F.col("p")))).first()[0]
    rows = [(c, points[g]) for c, g in courses]
    value = mean(rows)
    exact = sum(c * p for c, p in rows) / sum(c for c, _ in rows)
    assert 0 <= value <= R.RULES.highest_point and abs(value - exact) <= 0.005 + 1e-9
    assert mean([(2 * c, p) for c, p in rows]) == value and mean([*rows, (3, 0)]) <= value


def test_required_sgpa(spark):
    df = spark.createDataFrame([(8.0, 40, 40, 8.0), (5.0, 100, 20, 9.0), (9.0, 100, 20, 5.0), (8.0, 40, 0, 9.0), (11.0, 1, 1, 5.0), (math.nan, 1, 1, 5.0)], "c double, d int, l int, t double")
    got = R.required_sgpa(F.col("c"), F.col("d"), F.col("l"), F.col("t"))
    assert [(r.s, r.v) for r in df.select(got["status"].alias("s"), got["value"].alias("v")).collect()] == [("ok", 8.0), ("unreachable", None), ("ok", 0.0), ("insufficient_input", None), ("invalid_input", None), ("invalid_input", None)]


def test_unknown_formula_gives_null(spark):
    rules = R.RuleSet(percentage_formula="other")
    assert spark.range(1).select(R.percentage_of(F.lit(8.0), rules)).first()[0] is None
    assert R.grades_table(spark).where("not verified").count() == 3 and R.RULES.usable and not R.RuleSet(active=False).usable
