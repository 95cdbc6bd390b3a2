"""Cleaning: date parsing, date parts, imputation and IQR capping.

``prepare`` is the reference's ``preprocess_data`` as a Spark plan. Statistics
(null counts, medians, modes, quartiles) are computed with distributed passes
from ``operators.stats`` and folded into the returned plan as literals, so the
cleaned frame is one lazy projection over its input: no join, no shuffle.

Order of the steps matters and follows the reference: quartiles are taken
after imputation. Money columns stay DECIMAL(18,4); a capped money value is
the bound rounded half away from zero to 4 places (the bound itself is
computed exactly in decimal), so downstream sums stay exact.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, NumericType, StringType

from ..functions.dates import date_parts, day_lag, parse_date
from ..spec import DEFAULT_SPEC, SalesSpec
from .stats import column_modes, exact_quantiles, quantiles

IQR_K = 1.5


@dataclass
class CleaningStats:
    """What ``prepare`` learned about its input (all small values)."""
    null_counts: dict[str, int] = field(default_factory=dict)
    medians: dict[str, float | None] = field(default_factory=dict)
    modes: dict[str, object] = field(default_factory=dict)
    bounds: dict[str, tuple[float, float, float, float]] = field(default_factory=dict)
    fitted: bool = False   # True once computed; a fitted instance is reused as is
    lines: str | None = None   # file of the rows that it was fitted on, if kept

    def fills(self) -> tuple:
        """What imputation depends on."""
        return tuple(sorted(self.medians.items())), tuple(sorted(self.modes.items()))


def _lit_like(value, dtype) -> Column:
    """A literal of the column's type (decimal bounds rounded HALF_UP)."""
    if value is None:
        return F.lit(None).cast(dtype)
    if isinstance(dtype, DecimalType):
        exact = value if isinstance(value, Decimal) else Decimal(repr(float(value)))
        q = Decimal(1).scaleb(-dtype.scale)
        return F.lit(exact.quantize(q, rounding=ROUND_HALF_UP)).cast(dtype)
    return F.lit(value).cast(dtype)


def parse_dates(df: DataFrame, spec: SalesSpec = DEFAULT_SPEC, dates: str = "strict") -> DataFrame:
    """Order/ship date columns as DATE (text parsed, timestamps truncated)."""
    out = df
    for d in spec.dates:
        if d in out.columns:
            out = out.withColumn(d, parse_date(d, out.schema[d].dataType, dates))
    return out


def with_date_features(df: DataFrame, spec: SalesSpec = DEFAULT_SPEC,
                       dates: str = "strict", extra_parts: bool = False) -> DataFrame:
    """Parse the order/ship dates and add their date parts.

    ``extra_parts`` adds day of month, ISO week and the order-to-ship lag in
    days (the forecaster's variant)."""
    out = parse_dates(df, spec, dates)
    # extra_parts: False = analysis variant, True = forecaster variant,
    # "all" = both (used to fit statistics shared by the two variants)
    forecast = bool(extra_parts)
    analysis = extra_parts is False or extra_parts == "all"
    parts = []
    if spec.order_date in out.columns:
        parts += date_parts(spec.order_date, "order", extra=forecast)
    if spec.ship_date in out.columns and analysis:
        parts += date_parts(spec.ship_date, "ship")
    if forecast and spec.ship_date in out.columns and spec.order_date in out.columns:
        parts.append(day_lag(spec.ship_date, spec.order_date).alias("ship_lag"))
    return out.select("*", *parts) if parts else out


def numeric_columns(df: DataFrame, spec: SalesSpec = DEFAULT_SPEC) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in spec.identifiers]


def text_columns(df: DataFrame, spec: SalesSpec = DEFAULT_SPEC) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, StringType) or f.name in spec.identifiers]


def impute(df: DataFrame, spec: SalesSpec = DEFAULT_SPEC,
           stats: CleaningStats | None = None, method: str = "exact") -> DataFrame:
    """Fill nulls: numeric columns with their median, text and identifier
    columns with their mode. Only columns that have nulls are touched, so a
    complete table costs one counting pass."""
    stats = stats if stats is not None else CleaningStats()
    if not stats.fitted:
        counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first()
        stats.null_counts = {c: int(counts[c]) for c in df.columns}
        gaps = {c for c, k in stats.null_counts.items() if k > 0}
        num = [c for c in numeric_columns(df, spec) if c in gaps]
        txt = [c for c in text_columns(df, spec) if c in gaps]
        if num:
            q = quantiles(df, {c: [0.5] for c in num}, method)
            stats.medians = {c: q[c][0.5] for c in num}
        if txt:
            stats.modes = column_modes(df, txt)
    if not stats.medians and not stats.modes:
        return df
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name in stats.medians:
            m = stats.medians[f.name]
            if isinstance(f.dataType, DecimalType):
                out.append(F.coalesce(c, _lit_like(m, f.dataType)).alias(f.name))
            elif m is not None and float(m).is_integer() and f.dataType.typeName() in (
                    "integer", "long", "short", "byte"):
                out.append(F.coalesce(c, F.lit(int(m)).cast(f.dataType)).alias(f.name))
            else:  # an integer column imputed with x.5 becomes double, as in pandas
                out.append(F.coalesce(c.cast("double"), F.lit(m).cast("double")).alias(f.name))
        elif f.name in stats.modes:
            out.append(F.coalesce(c, F.lit(stats.modes[f.name]).cast(f.dataType)).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def iqr_bounds(df: DataFrame, cols: list[str], k: float = IQR_K,
               method: str = "exact", brackets: dict | None = None) -> dict[str, tuple]:
    """column -> (q1, q3, lower, upper) with lower = q1 - k*iqr, upper = q3 + k*iqr.
    ``method="approx"`` trades exactness for a single sketch pass; ``brackets``
    of kept sketches save the exact method its first one."""
    wanted = {c: [0.25, 0.75] for c in cols}
    q = exact_quantiles(df, wanted, brackets=brackets) if brackets else quantiles(df, wanted, method)
    out = {}
    for c in cols:
        q1, q3 = q[c][0.25], q[c][0.75]
        if q1 is None:
            out[c] = (None, None, None, None)
            continue
        iqr = q3 - q1
        kk = Decimal(repr(k)) if isinstance(iqr, Decimal) else k
        out[c] = (q1, q3, q1 - kk * iqr, q3 + kk * iqr)
    return out


def cap_expr(col: str, dtype, lower, upper) -> Column:
    """Winsorize: values below/above the bounds become the bound; null stays
    null (``greatest``/``least`` would turn a null into the bound)."""
    c = F.col(col)
    lo, hi = _lit_like(lower, dtype), _lit_like(upper, dtype)
    return F.when(c < lo, lo).when(c > hi, hi).otherwise(c).alias(col)


def cap_outliers(df: DataFrame, cols: list[str], k: float = IQR_K,
                 stats: CleaningStats | None = None, method: str = "exact") -> DataFrame:
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df
    if stats is not None and stats.fitted:
        b = stats.bounds
    else:
        b = iqr_bounds(df, cols, k, method)
        if stats is not None:
            stats.bounds = b
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[cap_expr(c, types[c], b[c][2], b[c][3]) if c in b and b[c][0] is not None
                       else F.col(c) for c in df.columns])


def prepare(df: DataFrame, spec: SalesSpec = DEFAULT_SPEC, dates: str = "strict",
            extra_parts: bool = False, stats: CleaningStats | None = None,
            quantile_method: str = "exact") -> DataFrame:
    """Dates -> date parts -> impute -> IQR cap (the reference's order)."""
    out = with_date_features(df, spec, dates, extra_parts)
    out = impute(out, spec, stats, quantile_method)
    out = cap_outliers(out, list(spec.capped), IQR_K, stats, quantile_method)
    if stats is not None:
        stats.fitted = True
    return out
