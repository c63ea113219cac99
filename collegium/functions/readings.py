"""What is known of one printed result row, as Columns: its kind of course, credits, grade, issues and readiness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from collegium.functions import rules as R
from collegium.functions.text import text_or_null

#: Grades that tell the kind of a course, and the greatest number of credits.
KIND_BY_GRADE = {"PP": "non_credit", "NP": "non_credit", "AU": "audit"}
MOST_CREDITS = 30


def course_kind(has_see: Column, reference_see: Column, letter: Column, internal: Column, external: Column, rules: R.RuleSet = R.RULES) -> tuple[Column, Column]:
    """(kind, from): the catalogue's word, else a grade's, else what the marks show; nulls if nothing tells."""
    known = F.coalesce(has_see, reference_see)
    by_grade = R.by_letter(letter, KIND_BY_GRADE)
    above = (internal > rules.cie_max) & (external.isNull() | (external == 0))
    kind = F.when(known, "see_bearing").when(~known, "cie_only").when(by_grade.isNotNull(), by_grade).when(external > 0, "see_bearing").when(above, "cie_only")
    source = F.when(known.isNotNull(), "catalogue").when(by_grade.isNotNull(), "grade").when((external > 0) | above, "marks")
    return kind, source


def has_see_of(kind: Column) -> Column:
    return F.when(kind == "see_bearing", True).when(kind == "cie_only", False)


def counts_toward_average(kind: Column) -> Column:
    return F.coalesce(kind.isin("see_bearing", "cie_only"), F.lit(False))


def row_issues(code: Column, title: Column, internal: Column, external: Column, total: Column, has_see: Column, credits: Column, announced: Column, rules: R.RuleSet = R.RULES) -> Column:
    """All issues of a row, in order, as field:issue."""
    internal_max = F.when(has_see, rules.cie_max).otherwise(rules.course_max)
    bounded = lambda name, value, most: F.when(value < 0, f"{name}:negative").when(value > most, f"{name}:too_large")
    return F.array_compact(
        F.array(
            F.when(text_or_null(code).isNull() & text_or_null(title).isNull(), "code:missing"),
            bounded("internal", internal, internal_max),
            bounded("external", external, F.lit(rules.course_max - rules.cie_max)),
            bounded("total", total, F.lit(rules.course_max)),
            F.when(total != internal + external, "total:does_not_add_up"),
            F.when((credits < 0) | (credits > MOST_CREDITS), "credits:out_of_range"),
            F.when(~announced.rlike(r"^\d{4}-\d{2}-\d{2}$"), "announced:format"),
        )
    )


def derivation(formula: str, clause: str, inputs: dict[str, Column], rules: R.RuleSet = R.RULES) -> Column:
    """How a value was derived: formula, clause, inputs and the rule set, as one nested value."""
    pairs = [x for name, value in inputs.items() for x in (F.lit(name), value.cast("double"))]
    return F.struct(F.lit(formula).alias("formula"), F.lit(clause).alias("clause"), F.create_map(*pairs).alias("inputs"), F.lit(rules.id).alias("ruleSetId"))


def usable(active: Column, verified: Column) -> Column:
    """Why a rule set can't be used, else null: not verified comes before not active."""
    return F.when(~verified, "not_verified").when(~active, "not_active")


def resolved_rule_set(pinned: Column, known: list[str], fallback: str = R.RULES.id) -> tuple[Column, Column]:
    """(rule set, status): the pinned one, the fallback where none is pinned, or unavailable."""
    status = F.when(pinned.isNull(), "fallback").when(pinned.isin(known), "pinned").otherwise("unavailable")
    return F.when(status == "fallback", fallback).when(status == "pinned", pinned), status


def blocking_reason(semester: Column, duplicate: Column, saved: Column, all_cards: Column) -> Column:
    """The first reason against importing a semester's files, else null."""
    return F.when(~all_cards, "not_a_card").when(semester.isNull(), "semester_unknown").when(duplicate == "differs", "files_differ").when(saved, "already_saved")


def ready_to_import(semester: Column, duplicate: Column, saved: Column, all_cards: Column, all_rows: Column) -> Column:
    return semester.isNotNull() & (duplicate != "differs") & ~saved & all_cards & all_rows
