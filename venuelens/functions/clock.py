"""Event time is ``timestamp_ntz`` in UTC; local time is a fixed +05:30 (IST).

Window bounds are computed once on the driver and compared with the raw column,
so that the comparison reaches the parquet scan. Dates are derived after the filter.
"""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET = timedelta(minutes=330)


def ntz(moment: datetime) -> Column:
    return F.expr(f"timestamp_ntz'{moment:%Y-%m-%d %H:%M:%S.%f}'")


def day(value: date) -> Column:
    return F.expr(f"date'{value:%Y-%m-%d}'")


def ist(ts: Column) -> Column:
    return ts + F.expr("interval '330' minute")


def ist_date(ts: Column) -> Column:
    return ist(ts).cast("date")


def between(ts: Column, start: datetime, end: datetime) -> Column:
    """Half open: ``start <= ts < end``."""
    return (ts >= ntz(start)) & (ts < ntz(end))


def daily_bounds(as_of: datetime) -> tuple[datetime, datetime]:
    """18:30 UTC two days back to 18:30 UTC one day back: one local day. After
    18:30 UTC the local date has moved on and this is the day before yesterday."""
    edge = as_of.replace(hour=18, minute=30, second=0, microsecond=0)
    return edge - timedelta(days=2), edge - timedelta(days=1)


def week_bounds(as_of: datetime) -> tuple[datetime, datetime, datetime]:
    """UTC instants (previous start, current start, current end) of the two local
    seven-day weeks that end yesterday. Half open, so the closed end of 23:59:59.999999
    in microseconds is the same set of rows."""
    today = datetime.combine((as_of + OFFSET).date(), time.min) - OFFSET
    return today - timedelta(days=14), today - timedelta(days=7), today


def parse_us(text: Column) -> Column:
    """``M/d/yyyy H:m:s`` (fields may be unpadded) to ``timestamp_ntz``, else null."""
    return F.try_to_timestamp(text, F.lit("M/d/yyyy H:m:s")).cast("timestamp_ntz")
