"""Quarter-end arithmetic on date columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days after a period's end by which its report is due.
DEADLINE_DAYS = 45


def quarter_end(day: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(day, "quarter"), 2))


def is_quarter_end(day: Column) -> Column:
    return day == quarter_end(day)


def previous_quarter(period: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(period, "month"), -3))


def next_quarter(period: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(period, "month"), 3))


def quarter_index(period: Column) -> Column:
    """Consecutive integers for consecutive quarters."""
    return F.year(period) * 4 + F.quarter(period) - 1


def quarter_label(period: Column) -> Column:
    return F.concat(F.year(period).cast("string"), F.lit("Q"), F.quarter(period).cast("string"))


def parse_quarter(label: Column) -> Column:
    """The end of a quarter named like 2024Q3; null for anything else."""
    year, quarter = F.regexp_extract(label, "^([0-9]{4})Q([1-4])$", 1), F.regexp_extract(label, "^([0-9]{4})Q([1-4])$", 2)
    return F.when(year != "", F.last_day(F.make_date(year.cast("int"), quarter.cast("int") * 3, F.lit(1))))


def deadline(period: Column) -> Column:
    return F.date_add(period, DEADLINE_DAYS)


def in_filing_window(day: Column) -> Column:
    return F.month(day).isin(2, 5, 8, 11) & (F.dayofmonth(day) <= 20)


def quarters_between(first: Column, last: Column) -> Column:
    """The quarter ends from first to last, both included."""
    return F.transform(F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 3 months")), lambda d: F.last_day(d))
