"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTHS = ["January", "February", "March", "April", "May", "June", "July",
          "August", "September", "October", "November", "December"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def weekday_name(c: Column | str) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.weekday(_col(c)) + 1)


def month_name(c: Column | str) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(_col(c)))


PARTS = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "weekday": F.weekday,
    "day_of_year": F.dayofyear, "week": F.weekofyear, "quarter": F.quarter,
}


def period_end(c: Column | str, freq: str) -> Column:
    """Label of the calendar period that holds the timestamp, as a date.

    D is the day, W the closing Sunday, M, Q and Y the last day of the period.
    """
    day = F.to_date(_col(c))
    if freq == "D":
        return day
    if freq == "W":
        return F.date_add(F.to_date(F.date_trunc("week", day)), 6)
    if freq == "M":
        return F.last_day(day)
    if freq == "Q":
        return F.last_day(F.add_months(F.to_date(F.date_trunc("quarter", day)), 2))
    if freq == "Y":
        return F.last_day(F.add_months(F.to_date(F.date_trunc("year", day)), 11))
    raise ValueError(f"unknown frequency {freq!r}")


def period_step(freq: str) -> Column:
    """Interval between neighbouring periods."""
    return F.expr({"D": "interval 1 day", "W": "interval 7 days", "M": "interval 1 month",
                   "Q": "interval 3 months", "Y": "interval 12 months"}[freq])
