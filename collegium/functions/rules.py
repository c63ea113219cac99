"""Grading rules as data, and the Column functions that apply them.

Every function takes and returns Columns, so a rule costs no shuffle and no Python on the executors. Unknown values
(nulls) stay unknown; a refusal is a code in a column, never an exception.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Grade bands (letter, points, least and greatest percentage), special grades (letter, whether their
# points are verified, whether they count), class bands (label, least percentage), thresholds in per cent.
BANDS = [("O", 10, 90, 100), ("A+", 9, 80, 89), ("A", 8, 70, 79), ("B+", 7, 60, 69), ("B", 6, 55, 59), ("C", 5, 50, 54), ("P", 4, 40, 49), ("F", 0, 0, 39)]
SPECIAL = [("DX", True, False), ("AU", True, False), ("PP", True, False), ("NP", True, False), ("AB", False, False), ("IC", False, False), ("W", False, False)]
CLASSES = [("FCD", 70.0), ("FC", 60.0), ("SC", 50.0), ("P", 40.0)]


@dataclass(frozen=True)
class RuleSet:
    """One rule set; the figures are those of the dimension tables' rows."""

    id: str = "regular-2022"
    cie_max: int = 50
    cie_min_pct: int = 40
    see_max: int = 100
    see_min_pct: int = 35
    course_max: int = 100
    overall_min_pct: int = 40
    attendance_required_pct: int = 85
    attendance_floor_pct: int = 75
    percentage_formula: str = "cgpa_times_10"
    decimals: int = 2
    active: bool = True
    verified: bool = True
    bands: list[tuple[str, int, int, int]] = field(default_factory=lambda: list(BANDS))

    @property
    def usable(self) -> bool:
        return self.active and self.verified

    @property
    def highest_point(self) -> int:
        return max((b[1] for b in self.bands), default=0)


RULES = RuleSet()
RULE_SETS = {RULES.id: RULES}

#: Percentage formulas by id; an unknown id gives null, which callers report as a refusal.
PERCENTAGE_FORMULAS = {"cgpa_times_10": lambda cgpa: cgpa * 10.0}


#: The same formulas as rows: id, factor.
FORMULAS = {"cgpa_x_10": 10.0}


def grades_table(spark: SparkSession, rules: RuleSet = RULES) -> DataFrame:
    """The grades dimension: letter, kind, points, counts (in averages), verified."""
    rows = [(b[0], "band", b[1], True, True) for b in rules.bands] + [(s[0], "special", 0, s[2], s[1]) for s in SPECIAL]
    return spark.createDataFrame(rows, "letter string, kind string, points int, counts boolean, verified boolean")


def half_up(value: Column, decimals: int = 2) -> Column:
    """Rounds half away from zero, with a tolerance of 1e-9 for binary fractions; -0 becomes 0."""
    scale = float(10**decimals)
    size = F.floor(F.abs(value) * scale + 0.5 + 1e-9) / scale
    return F.when(value < 0, -size).otherwise(size) + F.lit(0.0)


def half_up_by(value: Column, places: Column) -> Column:
    """half_up with the decimal places of a row; null for a value that is not finite, or places outside of 0 to 15."""
    factor = F.pow(F.lit(10.0), places)
    size = F.floor(F.abs(value) * factor + 0.5 + 1e-9) / factor
    return F.when(finite(value) & places.between(0, 15), F.when(value < 0, -size).otherwise(size) + F.lit(0.0))


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def by_letter(letter: Column, values: dict[str, object], default: object = None) -> Column:
    """A value by grade letter, trimmed and in any case, as a CASE rather than a join."""
    key, out = F.upper(F.trim(letter)), None
    for name, value in values.items():
        out = F.when(key == name, F.lit(value)) if out is None else out.when(key == name, F.lit(value))
    return out.otherwise(F.lit(default))


def grade_of_marks(total: Column, maximum: Column | float = 100.0, rules: RuleSet = RULES) -> Column:
    """The band's letter; the percentage is cut to a whole number first. Null outside 0 to the maximum."""
    maximum = F.lit(float(maximum)) if isinstance(maximum, (int, float)) else maximum
    pct = F.floor(total * 100.0 / maximum)
    out = F.when((total < 0) | (total > maximum), F.lit(None).cast("string"))
    for letter, _, low, _ in sorted(rules.bands, key=lambda b: -b[2]):
        out = out.when(pct >= low, letter)
    return out


def points_of(letter: Column, rules: RuleSet = RULES) -> Column:
    return by_letter(letter, {b[0]: b[1] for b in rules.bands} | {s[0]: 0 for s in SPECIAL if s[1]}).cast("int")


def counts_in_average(letter: Column, rules: RuleSet = RULES) -> Column:
    """Whether a grade counts; null for an unknown letter or one whose points are not verified."""
    return by_letter(letter, {b[0]: True for b in rules.bands} | {s[0]: s[2] for s in SPECIAL if s[1]}).cast("boolean")


def grade_refusal(letter: Column, rules: RuleSet = RULES) -> Column:
    """unknown_grade or unverified_grade, else null."""
    known = by_letter(letter, {b[0]: True for b in rules.bands} | {s[0]: True for s in SPECIAL}, False)
    verified = by_letter(letter, {s[0]: False for s in SPECIAL if not s[1]}, True)
    return F.when(letter.isNull() | ~known, "unknown_grade").when(~verified, "unverified_grade")


def marks_refusal(code: Column, internal: Column, external: Column, total: Column, has_see: Column, rules: RuleSet = RULES) -> Column:
    """The first reason why marks can't be evaluated, else null: code, number, range, then the sum."""
    cie_max = F.when(has_see, rules.cie_max).otherwise(rules.course_max)
    see_max = F.when(has_see, rules.course_max - rules.cie_max).otherwise(0)
    return (
        F.when(code.isNull() | ~code.rlike("^[A-Za-z][A-Za-z0-9]*$"), "invalid_code")
        .when(internal.isNull() | external.isNull() | total.isNull(), "missing_marks")
        .when((internal < 0) | (internal > cie_max), "internal_out_of_range")
        .when(~has_see & (external != 0), "external_without_see")
        .when((external < 0) | (external > see_max), "external_out_of_range")
        .when(total != internal + external, "total_disagrees")
    )


def heads(internal: Column, external: Column, total: Column, has_see: Column, rules: RuleSet = RULES) -> dict[str, Column]:
    """cie, see, overall (passed, failed, not_applicable) and passed, backlog."""
    cie_least = F.when(has_see, rules.cie_min_pct / 100 * rules.cie_max).otherwise(rules.cie_min_pct / 100 * rules.course_max)
    see_least = rules.see_min_pct / 100 * (rules.course_max - rules.cie_max)
    said = lambda ok: F.when(ok, "passed").otherwise("failed")
    cie, overall = said(internal >= cie_least), said(total >= rules.overall_min_pct / 100 * rules.course_max)
    see = F.when(~has_see, "not_applicable").otherwise(said(external >= see_least))
    passed = (cie == "passed") & (see != "failed") & (overall == "passed")
    return {"cie": cie, "see": see, "overall": overall, "passed": passed, "backlog": ~passed}


def percentages(rows: DataFrame, formulas: DataFrame, places: int = 2) -> DataFrame:
    """rows(cgpa, formula) with status and percentage, by a registry of formulas as rows: id, factor.

    invalid_input for a value that is not finite or below 0, unsupported_formula for an id that the registry has not:
    a row stays and says why, it is never left out.
    """
    known = formulas.select(F.col("id").alias("formula"), "factor")
    found = rows.join(known, "formula", "left")
    status = F.when(~F.coalesce(finite(F.col("cgpa")) & (F.col("cgpa") >= 0), F.lit(False)), "invalid_input").when(F.col("factor").isNull(), "unsupported_formula").otherwise("ok")
    return found.withColumn("status", status).withColumn("percentage", F.when(F.col("status") == "ok", half_up(F.col("cgpa") * F.col("factor"), places))).drop("factor")


def percentage_of(cgpa: Column, rules: RuleSet = RULES) -> Column:
    formula = PERCENTAGE_FORMULAS.get(rules.percentage_formula)
    return half_up(formula(cgpa), rules.decimals) if formula else F.lit(None).cast("double")


def class_of(percentage: Column) -> Column:
    """The first band, by descending least percentage, that holds it; none below the last."""
    out = F.when(percentage.isNull(), F.lit(None).cast("string"))
    for label, least in CLASSES:
        out = out.when(percentage >= least, label)
    return out.otherwise("none")


def countable(attended: Column, conducted: Column) -> Column:
    return (attended >= 0) & (conducted >= 0) & (attended <= conducted)


def attendance_pct(attended: Column, conducted: Column) -> Column:
    return F.try_divide(attended.cast("double"), conducted.cast("double")) * 100.0


def attendance_status(percentage: Column, rules: RuleSet = RULES) -> Column:
    return F.when(percentage.isNull(), "unknown").when(percentage >= rules.attendance_required_pct, "safe").when(percentage >= rules.attendance_floor_pct, "below_requirement").otherwise("dx_risk")


def can_miss(attended: Column, conducted: Column, rules: RuleSet = RULES) -> Column:
    raw = attended * 100.0 / rules.attendance_required_pct - conducted
    return F.when(conducted > 0, F.greatest(F.lit(0), F.floor(raw + 1e-9))).cast("bigint")


def must_attend(attended: Column, conducted: Column, rules: RuleSet = RULES) -> Column:
    t = float(rules.attendance_required_pct)
    raw = (t * conducted - 100.0 * attended) / (100.0 - t)
    return F.when(conducted > 0, F.when(attendance_pct(attended, conducted) >= t, 0).otherwise(F.greatest(F.lit(0), F.ceil(raw - 1e-9)))).cast("bigint")


def required_see(cie: Column, target_pct: Column, rules: RuleSet = RULES) -> dict[str, Column]:
    """status (ok, invalid_input, ineligible, unreachable), raw (of see_max), printed and binding."""
    scale = (rules.course_max - rules.cie_max) / rules.see_max
    head = rules.see_min_pct / 100 * rules.see_max
    needed = (target_pct / 100.0 * rules.course_max - cie) / scale
    raw = F.greatest(F.lit(0.0), F.ceil(F.greatest(F.lit(head), needed) - 1e-9).cast("double"))
    status = (
        F.when(cie.isNull() | (cie < 0) | (cie > rules.cie_max), "invalid_input")
        .when(cie < rules.cie_min_pct / 100 * rules.cie_max, "ineligible")
        .when(raw > rules.see_max, "unreachable")
        .otherwise("ok")
    )
    only = lambda c: F.when(status == "ok", c)
    return {"status": status, "raw": only(raw), "printed": only(raw * scale), "binding": only(F.when(needed > head, "overall_target").otherwise("see_minimum"))}


def required_sgpa(current: Column, done: Column, left: Column, target: Column, rules: RuleSet = RULES) -> dict[str, Column]:
    """status and value of the average that the remaining credits need."""
    top = float(rules.highest_point)
    need = F.try_divide(target * (done + left) - current * done, left.cast("double"))
    status = (
        F.when(~(finite(current) & finite(target)) | (done < 0) | (left < 0) | (current < 0) | (current > top) | (target < 0) | (target > top), "invalid_input")
        .when(left == 0, "insufficient_input")
        .when(need > top, "unreachable")
        .otherwise("ok")
    )
    return {"status": status, "value": F.when(status == "ok", half_up(F.greatest(F.lit(0.0), need), rules.decimals))}
