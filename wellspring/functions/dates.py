"""Date and time helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wellspring.fixed_values import DAYPART_OTHER, DAYPARTS

# Python/JS date formats of the application and their Spark patterns.
DATE_FORMATS = {
    "iso": "yyyy-MM-dd",          # %Y-%m-%d
    "month_key": "MMyy",          # %m%y (token month; does not sort by time)
    "long": "MMMM dd, yyyy",      # %B %d, %Y
    "day_month": "dd/MM",         # chart labels
    "short": "dd/MM/yy",          # history table
}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fmt(x, kind: str) -> Column:
    """Format a date/timestamp in one of the application's formats."""
    return F.date_format(_c(x), DATE_FORMATS[kind])


def month_key(ts) -> Column:
    """Token month ``MMyy`` (e.g. 2025-05 -> ``0525``)."""
    return F.date_format(_c(ts), "MMyy")


def previous_day(d) -> Column:
    """I7."""
    return F.date_sub(_c(d), 1)


def next_day(d) -> Column:
    """I7."""
    return F.date_add(_c(d), 1)


def leading_blanks(first_of_month) -> Column:
    """I8: Sunday-first calendar blanks before day 1 (JS ``getDay()``)."""
    return F.dayofweek(_c(first_of_month)) - 1


def days_in_month(d) -> Column:
    """I8."""
    return F.dayofmonth(F.last_day(_c(d)))


def daypart(ts) -> Column:
    """Morning [5, 12), afternoon [12, 18), otherwise evening."""
    h = F.hour(_c(ts))
    expr = None
    for lo, hi, name in DAYPARTS:
        cond = (h >= lo) & (h < hi)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(DAYPART_OTHER))


def parse_strict_date(x) -> Column:
    """Q6: ``%Y-%m-%d`` text (Python also takes one-digit month/day) -> DATE, else null."""
    c = _c(x)
    ok = c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$")
    return F.when(ok, F.try_to_date(c, "yyyy-M-d"))


_EPOCH = "1970-01-01 00:00:00"


def epoch_micros(ts) -> Column:
    """Microseconds since 1970-01-01 of a wall-clock timestamp, independent of
    the session time zone (TIMESTAMP_NTZ arithmetic, so no DST shifts)."""
    c = (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit(_EPOCH)), c)
