"""Aggregate and ratio expressions shared by the KPI operators.

Money is summed as DECIMAL(18,4) and only then turned into a double: decimal
addition is associative, so the result does not depend on how Spark splits the
rows over tasks (a double sum does, in its last bits).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,4)"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dsum(col: str | Column) -> Column:
    """Exact sum as DECIMAL; an empty or all-null group sums to 0."""
    return F.coalesce(F.sum(_c(col).cast(MONEY)), F.lit(0).cast(MONEY))


def money_sum(col: str | Column) -> Column:
    """Exact decimal sum returned as a double."""
    return dsum(col).cast("double")


def dmean(col: str | Column) -> Column:
    """Mean of non-null values computed as exact decimal sum / count."""
    return F.try_divide(F.sum(_c(col).cast(MONEY)).cast("double"),
                        F.count(_c(col)).cast("double"))


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den, null when den is 0 or null (never an error or inf)."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def pct(num: str | Column, den: str | Column) -> Column:
    """100 * num / den, null on a zero denominator."""
    return ratio(num, den) * F.lit(100.0)


def margin_pct(profit: str | Column = "profit", sales: str | Column = "sales") -> Column:
    """Profit margin % as a ratio of sums."""
    return pct(profit, sales)


def growth_pct(cur: Column, prev: Column) -> Column:
    """pandas ``pct_change() * 100`` = (cur / prev - 1) * 100; null (not inf)
    when prev is 0, null for the first row."""
    return (F.try_divide(cur, prev) - F.lit(1.0)) * F.lit(100.0)


def title_label(key: str | Column) -> Column:
    """``'monthly_sales'`` -> ``'Monthly Sales'``."""
    return F.initcap(F.regexp_replace(_c(key), "_", " "))


def currency(col: str | Column, places: int = 2) -> Column:
    """Presentation string such as ``$1234.50``."""
    return F.format_string(f"$%.{places}f", _c(col))
