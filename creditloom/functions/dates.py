"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(col: Column, fmt: str | None = None, strict: bool = True) -> Column:
    """String to date. A value that does not fit raises when ``strict``, else becomes null.

    ``try_to_timestamp`` is used in both cases so that the outcome does not hang on the session's ANSI setting.
    """
    parsed = (F.try_to_timestamp(col, F.lit(fmt)) if fmt else F.try_to_timestamp(col)).cast("date")
    if not strict:
        return parsed
    wanted = fmt or "yyyy-MM-dd"
    return F.when(
        col.isNotNull(),
        F.coalesce(parsed, F.raise_error(F.concat(F.lit(f"not a date in format {wanted}: "), col)).cast("date")),
    )


def in_window(date: Column, anchor: Column, months: int) -> Column:
    """True from ``months`` before the anchor (day clamped to the month's end) up to the anchor, both included."""
    return date.between(F.add_months(anchor, -months), anchor)


def months_back(date: Column, anchor: Column) -> Column:
    """How many calendar months ``date`` lies before the anchor's month: 0 in the same month."""
    return (F.year(anchor) - F.year(date)) * 12 + F.month(anchor) - F.month(date)


def month_start_back(anchor: Column, months: int) -> Column:
    """First day of the calendar month ``months`` before the anchor's."""
    return F.add_months(F.trunc(anchor, "MM"), -months)


def iso_date(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def whole_months_30(later: Column, earlier: Column) -> Column:
    """Days between, in blocks of 30, rounded down (also below zero)."""
    return F.floor(F.datediff(later, earlier) / 30)


def age_years(on: Column, born: Column) -> Column:
    """Days between in blocks of 365, rounded down."""
    return F.floor(F.datediff(on, born) / 365)


def date_parts(date: Column, prefix: str = "application") -> dict[str, Column]:
    """Month, weekday (Monday is 0), year and day of month, named ``<prefix>_<part>``."""
    return {
        f"{prefix}_month": F.month(date),
        f"{prefix}_day_of_week": F.weekday(date),
        f"{prefix}_year": F.year(date),
        f"{prefix}_day_of_month": F.dayofmonth(date),
    }
