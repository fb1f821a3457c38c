"""Crawl calendar helpers (timestamps as ``yyyyMMddHHmmss``, days as ``yyyyMMdd``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def crawl_timestamp(s) -> Column:
    return F.try_to_timestamp(_col(s), F.lit("yyyyMMddHHmmss"))


def crawl_day(s) -> Column:
    return F.try_to_date(_col(s), "yyyyMMdd")


def weekday(ts) -> Column:
    """0 = Monday ... 6 = Sunday."""
    return F.weekday(_col(ts))


def iso_week(day) -> Column:
    return F.weekofyear(_col(day))


def day_number(day, start) -> Column:
    """Days since ``start``."""
    return F.datediff(_col(day), _col(start))


def pair_weekday(day2) -> Column:
    """Weekday of the first day of a (day1, day2) pair."""
    return F.weekday(F.date_sub(_col(day2), 1))


def truncate_to_second(ts) -> Column:
    """Drop the fraction of a second without a time-zone round trip (works on
    TIMESTAMP_NTZ and TIMESTAMP alike)."""
    sec = F.date_part(F.lit("SECOND"), ts)
    return ts - F.make_dt_interval(secs=sec - F.floor(sec))
