"""Date arithmetic on integer day, business-day and period numbers.

All of these are built-in scalar expressions, so they stay inside generated
code and never need a lookup table or a join.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FREQUENCIES = ("daily", "weekly", "monthly", "quarterly", "annual")

# Day number 0 (1970-01-01) is a Thursday, three days after a Monday.
_MONDAY_SHIFT = 3


def day_number(date: Column) -> Column:
    """Days since 1970-01-01, the key that time-range frames are ordered by."""
    return F.unix_date(date)


def is_business_day(day: Column) -> Column:
    """Monday to Friday, from a day number."""
    return F.pmod(day + _MONDAY_SHIFT, F.lit(7)) < 5


def week_number(day: Column) -> Column:
    return F.floor((day + _MONDAY_SHIFT) / 7).cast("int")


def business_ordinal(day: Column) -> Column:
    """Position of a business day in the endless Monday-to-Friday calendar.

    On a gap-free business-day panel the difference of two ordinals equals the
    difference of their row positions, without numbering any rows.
    """
    return week_number(day) * 5 + F.least(F.pmod(day + _MONDAY_SHIFT, F.lit(7)), F.lit(5))


def period_number(date: Column, freq: str) -> Column:
    """Consecutive integer of the period ``date`` falls in."""
    if freq == "daily":
        return F.unix_date(date)
    if freq == "weekly":
        return week_number(F.unix_date(date))
    if freq == "monthly":
        return F.year(date) * 12 + F.month(date) - 1
    if freq == "quarterly":
        return F.year(date) * 4 + F.quarter(date) - 1
    if freq == "annual":
        return F.year(date)
    raise ValueError(f"unknown frequency {freq!r}; use one of {FREQUENCIES}")


def period_end(number: Column, freq: str) -> Column:
    """Last calendar day of a period: the label resampled rows carry."""
    if freq == "daily":
        return F.date_from_unix_date(number)
    if freq == "weekly":
        return F.date_from_unix_date((number * 7 + _MONDAY_SHIFT).cast("int"))
    if freq == "annual":
        return F.make_date(number, F.lit(12), F.lit(31))
    months = {"monthly": 1, "quarterly": 3}[freq]
    per_year = 12 // months
    year = F.floor(number / per_year).cast("int")
    last_month = (F.pmod(number, F.lit(per_year)) + 1) * months
    return F.last_day(F.make_date(year, last_month, F.lit(1)))
