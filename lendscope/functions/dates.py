"""Date parsing and date arithmetic on columns (all JVM-side built-ins)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two-digit years from this value up are 19xx, below it 20xx.
CENTURY_PIVOT = 70
# Fixed value: cutoff used for accounts that never had a loan.
NO_LOAN_CUTOFF = "1999-12-31"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_yymmdd(c, pivot: int = CENTURY_PIVOT) -> Column:
    """``'YYMMDD'`` text -> date; two-digit years ``>= pivot`` are 19xx.

    Spark's own ``yy`` pattern would read ``93`` as 2093, so the century is
    prefixed explicitly.  Malformed text gives NULL (lenient load).
    """
    s = F.trim(_col(c))
    yy = F.substring(s, 1, 2)
    century = F.when(yy.cast("int") >= pivot, F.lit("19")).otherwise(F.lit("20"))
    ok = s.rlike(r"^[0-9]{6}$")
    # an ISO text is cast without a formatter, several times faster than a pattern
    iso = F.concat(century, yy, F.lit("-"), F.substring(s, 3, 2), F.lit("-"), F.substring(s, 5, 2))
    return F.when(ok, iso.try_cast("date"))


def parse_yymmdd_time(c, pivot: int = CENTURY_PIVOT) -> Column:
    """``'YYMMDD HH:MM:SS'`` text -> date (the time of day is dropped)."""
    return parse_yymmdd(F.substring(F.trim(_col(c)), 1, 6), pivot)


def parse_yyyymmdd(c) -> Column:
    """``'YYYYMMDD'`` text -> date, NULL when malformed."""
    s = F.trim(_col(c))
    return F.when(s.rlike(r"^[0-9]{8}$"), F.try_to_date(s, "yyyyMMdd"))


def date_literal(value: str | _dt.date) -> Column:
    return F.lit(value if isinstance(value, _dt.date) else _dt.date.fromisoformat(value))


def days_between(end, start) -> Column:
    """Whole days from ``start`` to ``end`` (end - start)."""
    return F.datediff(_col(end), _col(start))


def years_between(end, start, days_per_year: int = 365, scale: int = 4) -> Column:
    """Day difference divided by ``days_per_year`` as ``decimal(12, scale)``."""
    return (days_between(end, start) / F.lit(float(days_per_year))).cast(f"decimal(12,{scale})")


def format_yymmdd(c) -> Column:
    """Date/timestamp -> ``'YYMMDD'`` text (inverse of :func:`parse_yymmdd`)."""
    d = _col(c)
    number = F.year(d) % 100 * 10000 + F.month(d) * 100 + F.dayofmonth(d)
    return F.lpad(number.cast("string"), 6, "0")  # a pattern takes several times as long


def format_yymmdd_time(c) -> Column:
    """Date/timestamp -> ``'YYMMDD HH:MM:SS'`` text (inverse of :func:`parse_yymmdd_time` on the day)."""
    t = _col(c).cast("timestamp")
    clock = [F.lpad(part(t).cast("string"), 2, "0") for part in (F.hour, F.minute, F.second)]
    return F.concat(format_yymmdd(c), F.lit(" "), clock[0], F.lit(":"), clock[1], F.lit(":"), clock[2])
