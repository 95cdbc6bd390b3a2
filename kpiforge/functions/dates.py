"""Date parsing and date-part expressions (all built-in, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, TimestampNTZType, TimestampType

# Text formats tried, in order, when a date column arrives as a string. The
# first is the US month/day/year form of the order-line exports.
DATE_FORMATS = ("M/d/yyyy", "yyyy-MM-dd", "M/d/yy", "yyyy/MM/dd")


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_date(col: str | Column, dtype=None, mode: str = "strict") -> Column:
    """Turn a string/timestamp column into a DATE.

    ``mode="strict"`` raises on text that matches no format (ANSI ``to_date``),
    ``mode="coerce"`` gives null instead. Timestamps are truncated to their
    calendar day (the order-line data is day-grained).
    """
    c = _c(col)
    if isinstance(dtype, DateType):
        return c
    if isinstance(dtype, (TimestampType, TimestampNTZType)):
        return c.cast("date")
    if dtype is not None and not isinstance(dtype, StringType):
        raise TypeError(f"cannot parse dates from {dtype}")
    tried = F.coalesce(*[F.try_to_date(c, f) for f in DATE_FORMATS])
    if mode == "coerce":
        return tried
    if mode != "strict":
        raise ValueError(f"unknown date mode {mode!r}")
    # raise explicitly, whatever the session's ANSI setting
    return (F.when(c.isNull() | tried.isNotNull(), tried)
            .otherwise(F.raise_error(F.concat(F.lit("unparseable date: "), c)).cast("date")))


def month_key(d: str | Column) -> Column:
    """``YYYY-MM`` bucket (pandas ``to_period('M')`` as text)."""
    return F.date_format(_c(d), "yyyy-MM")


def weekday0(d: str | Column) -> Column:
    """Day of week with Monday = 0 ... Sunday = 6."""
    return F.weekday(_c(d))


def date_parts(d: str | Column, prefix: str, extra: bool = False) -> list[Column]:
    """Year, month, quarter, weekday (and day of month, ISO week if extra)."""
    c = _c(d)
    cols = [F.year(c).cast("bigint").alias(f"{prefix}_year"),
            F.month(c).cast("bigint").alias(f"{prefix}_month"),
            F.quarter(c).cast("bigint").alias(f"{prefix}_quarter"),
            weekday0(c).cast("bigint").alias(f"{prefix}_dayofweek")]
    if extra:
        cols += [F.dayofmonth(c).cast("bigint").alias(f"{prefix}_dayofmonth"),
                 F.weekofyear(c).cast("bigint").alias(f"{prefix}_weekofyear")]
    return cols


def day_lag(later: str | Column, earlier: str | Column) -> Column:
    """Whole days from ``earlier`` to ``later`` (may be negative)."""
    return F.date_diff(_c(later), _c(earlier)).cast("bigint")


def day_name(d: str | Column) -> Column:
    return F.date_format(_c(d), "EEEE")


def month_name(d: str | Column) -> Column:
    return F.date_format(_c(d), "MMMM")


def month_label(d: str | Column) -> Column:
    """``August 2001`` style label."""
    return F.date_format(_c(d), "MMMM yyyy")


def cyclical_month(month: str | Column) -> tuple[Column, Column]:
    """sin and cos of 2*pi*month/12."""
    angle = F.lit(2.0 * 3.141592653589793) * _c(month).cast("double") / F.lit(12.0)
    return F.sin(angle), F.cos(angle)
