"""Column functions on dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats tried in turn, day first.
FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "d MMM yyyy", "d MMMM yyyy", "dd/MM/yy", "yyyy/MM/dd", "dd-MMM-yyyy", "dd MMM, yyyy", "MMM d, yyyy")


def parsed_date(c: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("date") for f in FORMATS])


def whole_months(a: Column, b: Column) -> Column:
    """Complete calendar months from a to b, at least 0."""
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a) - F.when(F.dayofmonth(b) < F.dayofmonth(a), 1).otherwise(0)
    return F.greatest(F.lit(0), months)


def age_in_months(a: Column, b: Column) -> Column:
    """Months from a to b, any day over counts as one more."""
    months = whole_months(a, b)
    return months + F.when(F.add_months(a, months) < b, 1).otherwise(0)


def months_before(anchor: Column, n: int) -> tuple[Column, Column]:
    """First and last day of the n complete months before anchor."""
    start = F.trunc(anchor, "MM")
    return F.add_months(start, -n), F.date_sub(start, 1)


def month_set(first: Column, last: Column) -> Column:
    """Array of yyyy-MM from first to last."""
    months = F.sequence(F.trunc(first, "MM"), F.trunc(last, "MM"), F.expr("interval 1 month"))
    return F.transform(months, lambda d: F.date_format(d, "yyyy-MM"))


def minutes_between(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 6e7)


def within_days(a: Column, b: Column, days: int) -> Column:
    return F.abs(F.datediff(a, b)) <= days


def stale(updated: Column, now: Column, minutes: int) -> Column:
    return minutes_between(updated, now) > minutes


def age_in_years(born: Column, at: Column, least: int = 18, most: int = 100) -> Column:
    """Whole years from born to at; null outside least..most."""
    years = F.year(at) - F.year(born) - F.when(F.month(at) * 100 + F.dayofmonth(at) < F.month(born) * 100 + F.dayofmonth(born), 1).otherwise(0)
    return F.when(years.between(least, most), years)


def reference_date(written: list[Column], default: Column) -> Column:
    """The first of some written dates that can be read, else the default."""
    return F.coalesce(*[parsed_date(c) for c in written], default)


def day_bounds(day: Column) -> tuple[Column, Column]:
    """First moment of a day and of the next, in the session's time zone."""
    return day.cast("date").cast("timestamp"), F.date_add(day.cast("date"), 1).cast("timestamp")


def cutoff_text(now: Column, days: int) -> Column:
    """A moment so many days before, as text that sorts like time."""
    return F.date_format(now.cast("timestamp") - F.make_dt_interval(F.lit(days)), "yyyy-MM-dd HH:mm:ss")
