"""Fiscal periods (``YYYYMM`` text), due dates and business days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def period_of(at: Column) -> Column:
    return F.date_format(at, "yyyyMM")


def period_start(period: Column) -> Column:
    return F.to_date(F.concat(period, F.lit("01")), "yyyyMMdd")


def period_end(period: Column) -> Column:
    """The last day."""
    return F.last_day(period_start(period))


def period_add(period: Column, months: Column | int) -> Column:
    return period_of(F.add_months(period_start(period), months))


def business_days(start: Column, end: Column) -> Column:
    """Mondays to Fridays after ``start`` up to and including ``end``, 0 where end is not later."""

    def upto(day: Column) -> Column:
        n = F.datediff(day, F.lit("1970-01-05").cast("date"))  # a Monday
        rest = F.pmod(n, F.lit(7))
        return (n - rest) / 7 * 5 + F.least(rest + 1, F.lit(5))

    return F.when(end > start, (upto(end) - upto(start)).cast("int")).otherwise(0)


def days_past_due(due: Column, today: Column) -> Column:
    return F.coalesce(F.datediff(today, due), F.lit(0))


def bucket_labels(bounds: list[int]) -> list[str]:
    if not bounds or len(bounds) > 12 or any(b <= 0 for b in bounds) or any(a >= b for a, b in zip(bounds, bounds[1:], strict=False)):
        raise ValueError("bounds must be 1 to 12 increasing positive numbers")
    lows = [1, *[b + 1 for b in bounds]]
    return ["current", *[f"{a}-{b}" for a, b in zip(lows, bounds, strict=False)], f"{bounds[-1]}+"]


def bucket_rank(days: Column, bounds: list[int]) -> Column:
    """0 for current, then the first bound that holds the days, then one more."""
    out = F.when(days <= 0, 0)
    for i, b in enumerate(bounds):
        out = out.when(days <= b, i + 1)
    return out.otherwise(len(bounds) + 1)
