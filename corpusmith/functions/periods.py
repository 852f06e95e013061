"""Calendar periods: end dates, start labels, heat-map labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FREQUENCIES = ("D", "W", "M", "Q", "Y")


def _check(freq: str) -> None:
    if freq not in FREQUENCIES:
        raise ValueError(f"frequency must be one of {FREQUENCIES}")


def as_time(c: Column) -> Column:
    """A string or timestamp as timestamp; null where it can't be read."""
    return F.try_to_timestamp(c.cast("string"))


def period_end(ts: Column, freq: str) -> Column:
    """The last day of the period; weeks end on Sunday."""
    _check(freq)
    d = F.to_date(ts)
    return {
        "D": lambda: d,
        "W": lambda: F.next_day(F.date_sub(d, 1), "SUN"),
        "M": lambda: F.last_day(d),
        "Q": lambda: F.last_day(F.add_months(F.to_date(F.date_trunc("quarter", d)), 2)),
        "Y": lambda: F.make_date(F.year(d), F.lit(12), F.lit(31)),
    }[freq]()


def period_label(ts: Column, freq: str) -> Column:
    """The period's start as text: day, Monday of the week, month, quarter, year."""
    _check(freq)
    d = F.to_date(ts)
    return {
        "D": lambda: F.date_format(d, "yyyy-MM-dd"),
        "W": lambda: F.date_format(F.date_trunc("week", d), "yyyy-MM-dd"),
        "M": lambda: F.date_format(d, "yyyy-MM"),
        "Q": lambda: F.concat(F.year(d), F.lit("Q"), F.quarter(d)),
        "Y": lambda: F.date_format(d, "yyyy"),
    }[freq]()


def heat_label(end: Column, freq: str) -> Column:
    """Labels of a heat map's columns."""
    _check(freq)
    return {
        "D": lambda: F.date_format(end, "yyyy-MM-dd"),
        "W": lambda: F.date_format(end, "yyyy-MM-dd"),
        "M": lambda: F.date_format(end, "yyyy-MM"),
        "Q": lambda: F.concat(F.year(end), F.lit(" Q"), F.quarter(end)),
        "Y": lambda: F.date_format(end, "yyyy"),
    }[freq]()
