"""Calendar stamps of instants in epoch seconds: whole-number arithmetic, free of the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_seconds(t: Column, offset_min: int = 0) -> Column:
    return t + F.lit(offset_min * 60)


def day_number(t: Column, offset_min: int = 0) -> Column:
    return F.floor(local_seconds(t, offset_min) / 86400).cast("long")


def civil_date(t: Column, offset_min: int = 0) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), day_number(t, offset_min).cast("int"))


def minute_of_day(t: Column, offset_min: int = 0) -> Column:
    return F.floor(F.pmod(local_seconds(t, offset_min), F.lit(86400)) / 60).cast("int")


def iso(t: Column, offset_min: int = 0) -> Column:
    """yyyy-MM-dd HH:mm +hh:mm"""
    m, sign = minute_of_day(t, offset_min), "-" if offset_min < 0 else "+"
    zone = f"{sign}{abs(offset_min) // 60:02d}:{abs(offset_min) % 60:02d}"
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    return F.concat(F.date_format(civil_date(t, offset_min), "yyyy-MM-dd"), F.lit(" "), two(F.floor(m / 60)), F.lit(":"), two(m % 60), F.lit(" " + zone))


def weekday(t: Column, offset_min: int = 0) -> Column:
    """Mon to Sun; day 0 of the epoch was a Thursday."""
    names = F.array(*[F.lit(d) for d in "Mon Tue Wed Thu Fri Sat Sun".split()])
    return F.element_at(names, (F.pmod(day_number(t, offset_min) + 3, F.lit(7)) + 1).cast("int"))


def business_hours(t: Column, offset_min: int = 0, start_min: int = 540, end_min: int = 1080) -> Column:
    """Monday to Friday, from start to before end."""
    m = minute_of_day(t, offset_min)
    return (F.pmod(day_number(t, offset_min) + 3, F.lit(7)) < 5) & (m >= start_min) & (m < end_min)


def fiscal_year(t: Column, offset_min: int = 0, start_month: int = 1) -> Column:
    """The year in which the fiscal year that holds t began."""
    d = civil_date(t, offset_min)
    return (F.year(d) - F.when(F.month(d) < start_month, 1).otherwise(0)).cast("long")


def fiscal_quarter(t: Column, offset_min: int = 0, start_month: int = 1) -> Column:
    return (F.floor(F.pmod(F.month(civil_date(t, offset_min)) - start_month, F.lit(12)) / 3) + 1).cast("int")


def relative_days(t: Column, as_of: Column, offset_min: int = 0) -> Column:
    """Local days from t to as_of: n is n days before as_of, -n after it."""
    return day_number(as_of, offset_min) - day_number(t, offset_min)


def tag(t: Column, as_of: Column, offset_min: int = 0, start_min: int = 540, end_min: int = 1080, start_month: int = 1) -> Column:
    """One line: iso (weekday, distance, business hours if within them, fiscal year and quarter)."""
    d = relative_days(t, as_of, offset_min)
    where = F.when(d == 0, "same day").otherwise(F.concat(F.abs(d).cast("string"), F.when(d > 0, " days before").otherwise(" days after")))
    hours = F.when(business_hours(t, offset_min, start_min, end_min), "business hours")
    fiscal = F.concat(F.lit("FY"), fiscal_year(t, offset_min, start_month).cast("string"), F.lit(" Q"), fiscal_quarter(t, offset_min, start_month).cast("string"))
    return F.concat(iso(t, offset_min), F.lit(" ("), F.concat_ws(", ", weekday(t, offset_min), where, hours, fiscal), F.lit(")"))
