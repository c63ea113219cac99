"""Marks of single classes and what they do to a subject's counts, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: days for which marks of single classes are kept.
RETENTION_DAYS = 14


def mark_id(date: Column, slot: Column) -> Column:
    """The key of one class on one day."""
    return F.concat_ws(":", date.cast("string"), slot)


def attended_of(outcome: Column) -> Column:
    return (F.coalesce(outcome, F.lit("")) == "attended").cast("bigint")


def conducted_of(outcome: Column) -> Column:
    return outcome.isNotNull().cast("bigint")


def count_delta(before: Column, after: Column) -> tuple[Column, Column]:
    """(attended, conducted) that moving a mark adds; null is a class without a mark."""
    return attended_of(after) - attended_of(before), conducted_of(after) - conducted_of(before)


def apply_delta(attended: Column, conducted: Column, delta: tuple[Column, Column]) -> tuple[Column, Column]:
    """Counts moved by a delta, so that 0 <= attended <= conducted holds after it."""
    held = F.greatest(F.lit(0), conducted + delta[1])
    return F.least(held, F.greatest(F.lit(0), attended + delta[0])), held


def stale(date: Column, today: Column) -> Column:
    return date < F.date_sub(today, RETENTION_DAYS)
