"""How figures, times and days are shown, as Columns; nothing here computes an academic value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, places: int) -> Column:
    """So many decimals, halves up."""
    return F.round(value, places).cast(f"decimal(20,{places})").cast("string")


def percent(value: Column) -> Column:
    return F.concat(fixed(value, 1), F.lit("%"))


def counted(value: Column, singular: str, plural: str | None = None) -> Column:
    return F.concat(value.cast("string"), F.lit(" "), F.when(value == 1, singular).otherwise(plural or f"{singular}s"))


def clock(value: Column) -> Column:
    """09:30 as 9:30 am; what has no hour stays as it is."""
    parts = F.split(value, ":")
    hour = parts[0].try_cast("int")
    shown = F.concat(F.when(hour % 12 == 0, 12).otherwise(hour % 12).cast("string"), F.lit(":"), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("00")), F.when(hour < 12, " am").otherwise(" pm"))
    return F.coalesce(shown, value)


def local_day(moment: Column, zone: str) -> Column:
    """The day of a UTC moment where the reader is."""
    return F.date_format(F.from_utc_timestamp(moment, zone), "yyyy-MM-dd")


def day(value: Column) -> Column:
    """2026-07-15 as 15 Jul 2026; what is no date stays as it is."""
    return F.coalesce(F.date_format(F.try_to_date(value, "yyyy-MM-dd"), "d MMM yyyy"), value)


def metric(value: Column, status: Column, reason: Column, shown: Column) -> tuple[Column, Column]:
    """(value, note): an absent figure says so with its reason, and one that is not settled keeps its caveat."""
    note = F.when(value.isNull() | (status != "resolved"), reason)
    return F.when(value.isNull(), "Unavailable").otherwise(shown), note


def either(reasons: Column) -> Column:
    """An array of reasons as a, b or c."""
    n = F.size(reasons)
    last = F.try_element_at(reasons, F.lit(-1))
    joined = F.concat(F.array_join(F.slice(reasons, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(" or "), last)
    return F.when(n == 0, "no grade or credits").when(n == 1, last).otherwise(joined)
