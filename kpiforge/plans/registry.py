"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and their SQL.

Every query reads the driver tables of ``sf_dir`` in full. ``ORACLE`` holds
the independent DuckDB statement for each query that has one; the ML ones
(model fits) are checked on row counts and by the tests instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import date_parts, day_lag
from ..functions.measures import currency, dsum, title_label
from ..operators import clean, forecast, kpi, leastsq, ml, partials, profile, series, stats
from ..sources.tables import fact_columns
from ..spec import DEFAULT_SPEC as S
from . import oracle_sql as O
from .frames import (cleaning_stats, fitted_once, line_partials, line_partitions, measured_lines, prepared_fact,
                     raw_fact, with_gaps)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


M, R, MG = O.money, O.ratio, O.margin

# ---------------------------------------------------------------------------
# Source
# ---------------------------------------------------------------------------


@register("sales_fact", O.on_raw("SELECT * FROM fact"))
def q_sales_fact(spark, sf):
    return raw_fact(spark, sf)


# ---------------------------------------------------------------------------
# Profiling and cleaning
# ---------------------------------------------------------------------------

def _null_profile_sql() -> str:
    parts = " UNION ALL\n".join(
        f"SELECT '{c}' AS column, CAST(count_if({c} IS NULL) AS BIGINT) AS null_count FROM gapped"
        for c in fact_columns())
    return O.GAPPED + f"SELECT * FROM ({parts}) WHERE null_count > 0"


@register("null_profile", _null_profile_sql())
def q_null_profile(spark, sf):
    return stats.null_profile(with_gaps(raw_fact(spark, sf)))


@register("table_shape", O.on_raw("SELECT COUNT(*) AS rows, CAST(18 AS BIGINT) AS columns FROM fact"))
def q_table_shape(spark, sf):
    return profile.shape(raw_fact(spark, sf))


@register("sample_rows", O.on_raw("SELECT * FROM fact ORDER BY row_id LIMIT 5"))
def q_sample_rows(spark, sf):
    """The five order lines with the smallest row ids."""
    return profile.sample_rows(raw_fact(spark, sf), 5, S.row_id)


def _profile_sql() -> str:
    cols = fact_columns()
    types = ["string", "bigint", "date", "date", "string", "bigint", "string", "string",
             "string", "string", "bigint", "string", "string", "string", "double", "double",
             "decimal(18,4)", "decimal(18,4)"]
    parts = " UNION ALL\n".join(
        f"SELECT '{c}' AS column, CAST({i} AS BIGINT) AS position, '{t}' AS dtype, "
        f"COUNT({c}) AS non_null, COUNT(*) - COUNT({c}) AS nulls FROM gapped"
        for i, (c, t) in enumerate(zip(cols, types)))
    return O.GAPPED + parts


@register("column_profile", _profile_sql())
def q_column_profile(spark, sf):
    """Type and completeness of every order-line column (with injected gaps)."""
    return profile.column_profile(with_gaps(raw_fact(spark, sf)))


def _median_sql() -> str:
    h = "((count(sales) - 1) * 0.5)"
    lst = "list_sort(list(sales) FILTER (WHERE sales IS NOT NULL))"
    med_sales = (f"{lst}[CAST(floor({h}) AS BIGINT) + 1] + ({lst}[CAST(ceil({h}) AS BIGINT) + 1]"
                 f" - {lst}[CAST(floor({h}) AS BIGINT) + 1]) * CAST({h} - floor({h}) AS DECIMAL(10,4))")
    return O.GAPPED + f"""
, med AS (SELECT quantile_cont(quantity, 0.5) AS mq, quantile_cont(discount, 0.5) AS md,
                 {med_sales} AS ms FROM gapped)
SELECT row_id, COALESCE(quantity, mq) AS quantity, COALESCE(discount, md) AS discount,
       COALESCE(sales, CAST(ms AS DECIMAL(18,4))) AS sales
FROM gapped, med"""


@register("median_impute", _median_sql())
def q_median_impute(spark, sf):
    cols = [S.row_id, S.order_id, S.customer_id, S.product_id, S.quantity, S.discount, S.sales]
    filled = clean.impute(with_gaps(raw_fact(spark, sf, cols)))
    return filled.select(S.row_id, S.quantity, S.discount, S.sales)


@register("mode_impute", O.GAPPED + """
, m AS (SELECT
   (SELECT segment FROM gapped WHERE segment IS NOT NULL GROUP BY segment
    ORDER BY count(*) DESC, segment LIMIT 1) AS ms,
   (SELECT ship_mode FROM gapped WHERE ship_mode IS NOT NULL GROUP BY ship_mode
    ORDER BY count(*) DESC, ship_mode LIMIT 1) AS mm)
SELECT row_id, COALESCE(segment, ms) AS segment, COALESCE(ship_mode, mm) AS ship_mode
FROM gapped, m""")
def q_mode_impute(spark, sf):
    cols = [S.row_id, S.order_id, S.customer_id, S.segment, S.ship_mode]
    filled = clean.impute(with_gaps(raw_fact(spark, sf, cols)))
    return filled.select(S.row_id, S.segment, S.ship_mode)


@register("iqr_bounds", O.on_prepared("""
SELECT * FROM (
  SELECT 'sales' AS column, CAST(q1_sales AS DOUBLE) AS q1, CAST(q3_sales AS DOUBLE) AS q3,
         CAST(q3_sales - q1_sales AS DOUBLE) AS iqr, CAST(lo_sales AS DOUBLE) AS lower_bound,
         CAST(hi_sales AS DOUBLE) AS upper_bound FROM quartiles, bounds
  UNION ALL SELECT 'profit', CAST(q1_profit AS DOUBLE), CAST(q3_profit AS DOUBLE),
         CAST(q3_profit - q1_profit AS DOUBLE), CAST(lo_profit AS DOUBLE),
         CAST(hi_profit AS DOUBLE) FROM quartiles, bounds
  UNION ALL SELECT 'quantity', q1_quantity, q3_quantity, q3_quantity - q1_quantity,
         lo_quantity, hi_quantity FROM quartiles, bounds
  UNION ALL SELECT 'discount', q1_discount, q3_discount, q3_discount - q1_discount,
         lo_discount, hi_discount FROM quartiles, bounds)"""))
def q_iqr_bounds(spark, sf):
    # this report is the fit: never a remembered one, but the next queries use it
    return _bounds_frame(spark, cleaning_stats(spark, sf, fresh=True).bounds)


def _bounds_frame(spark, bounds) -> DataFrame:
    rows = [(c, *[None if v is None else float(v) for v in
                  (q1, q3, None if q1 is None else q3 - q1, lo, hi)])
            for c, (q1, q3, lo, hi) in bounds.items()]
    return spark.createDataFrame(
        rows, "column string, q1 double, q3 double, iqr double, lower_bound double, "
              "upper_bound double")


@register("iqr_bounds_by_file", ORACLE["iqr_bounds"])
def q_iqr_bounds_by_file(spark, sf):
    """The same bounds, the ranks bracketed from sketches kept per file."""
    st, cols = cleaning_stats(spark, sf), list(S.capped)
    sketches, _ = line_partials(spark, sf, "quantiles", cols,
                                lambda df: partials.quantile_partials(df, cols),
                                lambda df: clean.impute(df, S, st), st.fills())
    ranks = partials.sketched_ranks(sketches, {c: (0.25, 0.75) for c in cols})
    return _bounds_frame(spark, clean.iqr_bounds(measured_lines(spark, sf), cols, brackets=ranks))


@register("monthly_series_by_file", O.on_raw(O.monthly_cte(("category",)).replace("FROM prepared", "FROM fact") + """
SELECT category, year, month, date, sales, profit, quantity, avg_discount, order_count FROM ms"""))
def q_monthly_series_by_file(spark, sf):
    """Months of the raw lines by category, from sums kept per file."""
    cols = [S.order_date, S.category, S.sales, S.profit, S.quantity, S.discount, S.order_id]
    kept, _ = line_partials(spark, sf, "months", cols, lambda df: partials.monthly_partials(df, [S.category]))
    return series.public(partials.merged_months(kept, [S.category]))


@register("segment_distinct_rollup", O.on_raw("""
SELECT segment, year(order_date) AS year, COUNT(DISTINCT customer_id) AS customer_id,
       COUNT(DISTINCT order_id) AS order_id
FROM fact WHERE order_date IS NOT NULL GROUP BY segment, year(order_date)"""))
def q_segment_distinct_rollup(spark, sf):
    """Customers and orders of every segment and year, united from sketches kept
    per file, month and segment (exact up to 65,536 different ones)."""
    ids = [S.customer_id, S.order_id]
    kept, _ = line_partials(spark, sf, "distinct", [S.order_date, S.segment, *ids],
                            lambda df: partials.distinct_partials(df.where(F.col(S.order_date).isNotNull()),
                                                                  [S.segment], ids, S.order_date))
    return partials.distinct_rollup(kept, [S.segment, "year"], ids)


def _capped_totals_sql() -> str:
    parts = []
    for c in O.CAPPED:
        t = "DECIMAL(18,4)" if c in O.MONEY_COLS else "DOUBLE"
        parts.append(f"""SELECT '{c}' AS column,
    CAST(count_if(i.{c} < CAST(lo_{c} AS {t})) AS BIGINT) AS n_capped_low,
    CAST(count_if(i.{c} > CAST(hi_{c} AS {t})) AS BIGINT) AS n_capped_high,
    CAST(SUM(CAST(i.{c} AS DECIMAL(18,4))) AS DOUBLE) AS total_before,
    CAST(SUM(CAST(CASE WHEN i.{c} < CAST(lo_{c} AS {t}) THEN CAST(lo_{c} AS {t})
                       WHEN i.{c} > CAST(hi_{c} AS {t}) THEN CAST(hi_{c} AS {t})
                       ELSE i.{c} END AS DECIMAL(18,4))) AS DOUBLE) AS total_after
  FROM imputed i, bounds""")
    return O.on_prepared("SELECT * FROM (" + "\nUNION ALL ".join(parts) + ")")


@register("iqr_capped_totals", _capped_totals_sql())
def q_iqr_capped_totals(spark, sf):
    st = cleaning_stats(spark, sf)
    cols = list(S.capped)
    imputed = measured_lines(spark, sf)
    types = {f.name: f.dataType for f in imputed.schema.fields}
    aggs = []
    for c in cols:
        lo, hi = st.bounds[c][2], st.bounds[c][3]
        lo_l, hi_l = clean._lit_like(lo, types[c]), clean._lit_like(hi, types[c])
        capped = clean.cap_expr(c, types[c], lo, hi)
        aggs.append(F.struct(
            F.lit(c).alias("column"),
            F.count_if(F.col(c) < lo_l).cast("bigint").alias("n_capped_low"),
            F.count_if(F.col(c) > hi_l).cast("bigint").alias("n_capped_high"),
            dsum(c).cast("double").alias("total_before"),
            dsum(capped).cast("double").alias("total_after")).alias(c))
    row = imputed.agg(*aggs)
    return row.select(F.explode(F.array(*[F.col(c) for c in cols])).alias("r")).select("r.*")


@register("prepared_totals", O.on_prepared(f"""
SELECT category, COUNT(*) AS line_count, {M('sales')} AS sales, {M('profit')} AS profit,
       {M('quantity')} AS quantity,
       CAST(SUM(CAST(discount AS DECIMAL(18,4))) AS DOUBLE) / CAST(COUNT(discount) AS DOUBLE)
         AS avg_discount
FROM prepared GROUP BY category"""))
def q_prepared_totals(spark, sf):
    from ..functions.measures import dmean, money_sum
    p = prepared_fact(spark, sf, [S.category, S.sales, S.profit, S.quantity, S.discount])
    return p.groupBy(S.category).agg(
        F.count(F.lit(1)).cast("bigint").alias("line_count"),
        money_sum(S.sales).alias("sales"), money_sum(S.profit).alias("profit"),
        money_sum(S.quantity).alias("quantity"), dmean(S.discount).alias("avg_discount"))


@register("date_features", O.on_raw("""
SELECT row_id, year(order_date) AS order_year, month(order_date) AS order_month,
       quarter(order_date) AS order_quarter, isodow(order_date) - 1 AS order_dayofweek,
       day(order_date) AS order_dayofmonth, weekofyear(order_date) AS order_weekofyear,
       year(ship_date) AS ship_year, month(ship_date) AS ship_month,
       quarter(ship_date) AS ship_quarter, isodow(ship_date) - 1 AS ship_dayofweek,
       CAST(date_diff('day', order_date, ship_date) AS BIGINT) AS ship_lag
FROM fact"""))
def q_date_features(spark, sf):
    f = raw_fact(spark, sf, [S.row_id, S.order_date, S.ship_date])
    return f.select(S.row_id, *date_parts(S.order_date, "order", extra=True),
                    *date_parts(S.ship_date, "ship"),
                    day_lag(S.ship_date, S.order_date).alias("ship_lag"))


@register("text_dates", O.on_raw("""
SELECT row_id, order_date, CASE WHEN order_id % 29 = 0 THEN NULL ELSE order_date END AS coerced_date
FROM fact"""))
def q_text_dates(spark, sf):
    """Order dates as exported text, parsed strictly, and (some unreadable) coerced."""
    f = raw_fact(spark, sf, [S.row_id, S.order_id, S.order_date])
    text = F.date_format(S.order_date, "M/d/yyyy")
    strict = clean.parse_dates(f.withColumn(S.order_date, text))
    spoilt = strict.withColumn("_date", F.col(S.order_date)).withColumn(
        S.order_date, F.when(F.col(S.order_id) % 29 == 0, F.lit("no date")).otherwise(text))
    return clean.parse_dates(spoilt, dates="coerce").select(
        S.row_id, F.col("_date").alias("order_date"), F.col(S.order_date).alias("coerced_date"))


@register("ship_lag_profile", O.on_raw("""
SELECT CAST(date_diff('day', order_date, ship_date) AS BIGINT) AS ship_lag,
       COUNT(*) AS line_count FROM fact GROUP BY 1 ORDER BY 1"""))
def q_ship_lag_profile(spark, sf):
    f = raw_fact(spark, sf, [S.order_date, S.ship_date])
    return (f.groupBy(day_lag(S.ship_date, S.order_date).alias("ship_lag"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("line_count")).orderBy("ship_lag"))


# ---------------------------------------------------------------------------
# KPI tables on the prepared frame
# ---------------------------------------------------------------------------

@register("monthly_sales", O.on_prepared(f"""
SELECT strftime(order_date, '%Y-%m') AS month, {M('sales')} AS sales,
       {M('profit')} AS profit, COUNT(order_id) AS order_count
FROM prepared WHERE order_date IS NOT NULL GROUP BY 1 ORDER BY 1"""))
def q_monthly_sales(spark, sf):
    cols = [S.order_date, S.sales, S.profit, S.order_id]
    return kpi.monthly_sales(prepared_fact(spark, sf, cols))


_GROWTH_SQL = f"""
, m AS (SELECT strftime(order_date, '%Y-%m') AS month, {M('sales')} AS sales,
       {M('profit')} AS profit, COUNT(order_id) AS order_count
  FROM prepared WHERE order_date IS NOT NULL GROUP BY 1)
, g AS (SELECT *,
   (sales / NULLIF(lag(sales) OVER (ORDER BY month), 0) - 1.0) * 100.0 AS sales_growth_rate,
   (profit / NULLIF(lag(profit) OVER (ORDER BY month), 0) - 1.0) * 100.0 AS profit_growth_rate
  FROM m)
"""


@register("monthly_growth", O.on_prepared(_GROWTH_SQL + "SELECT * FROM g ORDER BY month"))
def q_monthly_growth(spark, sf):
    cols = [S.order_date, S.sales, S.profit, S.order_id]
    return kpi.monthly_growth(prepared_fact(spark, sf, cols))


@register("recent_growth", O.on_prepared(_GROWTH_SQL + """
SELECT month, sales, sales_growth_rate, profit, profit_growth_rate
FROM g ORDER BY month DESC LIMIT 5"""))
def q_recent_growth(spark, sf):
    cols = [S.order_date, S.sales, S.profit, S.order_id]
    return kpi.recent_growth(prepared_fact(spark, sf, cols))


@register("category_performance", O.on_prepared(f"""
SELECT category, {M('sales')} AS sales, {M('profit')} AS profit, {M('quantity')} AS quantity,
       COUNT(DISTINCT order_id) AS order_count,
       {MG(M('profit'), M('sales'))} AS profit_margin
FROM prepared WHERE category IS NOT NULL GROUP BY category ORDER BY sales DESC, category"""))
def q_category_performance(spark, sf):
    cols = [S.category, S.sales, S.profit, S.quantity, S.order_id]
    return kpi.category_performance(prepared_fact(spark, sf, cols), partitions=line_partitions(spark, sf))


@register("subcategory_performance", O.on_prepared(f"""
SELECT category, sub_category, {M('sales')} AS sales, {M('profit')} AS profit,
       {M('quantity')} AS quantity, COUNT(DISTINCT order_id) AS order_count,
       {MG(M('profit'), M('sales'))} AS profit_margin
FROM prepared WHERE category IS NOT NULL AND sub_category IS NOT NULL
GROUP BY category, sub_category ORDER BY sales DESC, category, sub_category"""))
def q_subcategory_performance(spark, sf):
    cols = [S.category, S.sub_category, S.sales, S.profit, S.quantity, S.order_id]
    return kpi.subcategory_performance(prepared_fact(spark, sf, cols), partitions=line_partitions(spark, sf))


@register("segment_performance", O.on_prepared(f"""
SELECT segment, {M('sales')} AS sales, {M('profit')} AS profit,
       COUNT(DISTINCT customer_id) AS customer_count, COUNT(DISTINCT order_id) AS order_count,
       {MG(M('profit'), M('sales'))} AS profit_margin,
       {R(M('sales'), 'COUNT(DISTINCT customer_id)')} AS sales_per_customer,
       {R(M('profit'), 'COUNT(DISTINCT customer_id)')} AS profit_per_customer
FROM prepared WHERE segment IS NOT NULL GROUP BY segment ORDER BY segment"""))
def q_segment_performance(spark, sf):
    cols = [S.segment, S.sales, S.profit, S.customer_id, S.order_id]
    return kpi.segment_performance(prepared_fact(spark, sf, cols))


@register("category_ratio", O.on_prepared(f"""
SELECT category, {M('sales')} AS sales, {M('profit')} AS profit,
       {MG(M('profit'), M('sales'))} AS profit_margin,
       {R(M('sales'), M('profit'))} AS sales_to_profit_ratio
FROM prepared WHERE category IS NOT NULL GROUP BY category ORDER BY category"""))
def q_category_ratio(spark, sf):
    return kpi.category_ratio(prepared_fact(spark, sf, [S.category, S.sales, S.profit]))


@register("regional_performance", O.on_prepared(f"""
SELECT region, state, {M('sales')} AS sales, {M('profit')} AS profit,
       COUNT(DISTINCT order_id) AS order_count, {MG(M('profit'), M('sales'))} AS profit_margin
FROM prepared WHERE region IS NOT NULL AND state IS NOT NULL
GROUP BY region, state ORDER BY sales DESC, region, state"""))
def q_regional_performance(spark, sf):
    cols = [S.region, S.state, S.sales, S.profit, S.order_id]
    return kpi.regional_performance(prepared_fact(spark, sf, cols))


@register("state_performance", O.on_prepared(f"""
SELECT state, {M('sales')} AS sales, {M('profit')} AS profit,
       {MG(M('profit'), M('sales'))} AS profit_margin
FROM prepared WHERE state IS NOT NULL GROUP BY state ORDER BY state"""))
def q_state_performance(spark, sf):
    return kpi.state_performance(prepared_fact(spark, sf, [S.state, S.sales, S.profit]))


@register("shipping_performance", O.on_prepared(f"""
SELECT ship_mode, {M('sales')} AS sales, {M('profit')} AS profit,
       COUNT(DISTINCT order_id) AS order_count, {MG(M('profit'), M('sales'))} AS profit_margin,
       {R(M('sales'), 'COUNT(DISTINCT order_id)')} AS avg_order_value
FROM prepared WHERE ship_mode IS NOT NULL GROUP BY ship_mode ORDER BY ship_mode"""))
def q_shipping_performance(spark, sf):
    cols = [S.ship_mode, S.sales, S.profit, S.order_id]
    return kpi.shipping_performance(prepared_fact(spark, sf, cols))


@register("category_hierarchy", O.on_prepared("""
SELECT CASE WHEN GROUPING(sub_category) = 1 THEN 'category' ELSE 'sub_category' END AS level,
       category, sub_category,
       CAST(COALESCE(SUM(CAST(sales AS DECIMAL(18,4))), 0) AS DOUBLE) AS sales,
       CAST(SUM(CAST(profit AS DECIMAL(18,4)) * CAST(sales AS DECIMAL(19,4))) AS DOUBLE)
         / NULLIF(CAST(COALESCE(SUM(CAST(sales AS DECIMAL(18,4))), 0) AS DOUBLE), 0)
         AS weighted_profit
FROM prepared WHERE category IS NOT NULL AND sub_category IS NOT NULL
GROUP BY GROUPING SETS ((category), (category, sub_category))
ORDER BY level, category, sub_category NULLS FIRST"""))
def q_category_hierarchy(spark, sf):
    cols = [S.category, S.sub_category, S.sales, S.profit]
    return kpi.category_hierarchy(prepared_fact(spark, sf, cols))


# ---------------------------------------------------------------------------
# Dashboard tables on the raw frame
# ---------------------------------------------------------------------------

@register("dash_monthly_trend", O.on_raw(f"""
SELECT strftime(order_date, '%Y-%m') AS month, {M('sales')} AS sales,
       {M('profit')} AS profit, COUNT(order_id) AS order_count
FROM fact WHERE order_date IS NOT NULL GROUP BY 1 ORDER BY 1"""))
def q_dash_monthly_trend(spark, sf):
    return kpi.monthly_sales(raw_fact(spark, sf, [S.order_date, S.sales, S.profit, S.order_id]))


def _share_sql(key: str) -> str:
    return O.on_raw(f"""
, g AS (SELECT {key}, SUM(CAST(sales AS DECIMAL(18,4))) AS s FROM fact
        WHERE {key} IS NOT NULL GROUP BY {key})
SELECT {key}, CAST(s AS DOUBLE) AS sales,
       CAST(s AS DOUBLE) / NULLIF(CAST(SUM(s) OVER () AS DOUBLE), 0) * 100.0 AS share_pct
FROM g ORDER BY {key}""")


@register("dash_category_share", _share_sql("category"))
def q_dash_category_share(spark, sf):
    return kpi.dash_category_share(raw_fact(spark, sf, [S.category, S.sales]))


@register("dash_segment_share", _share_sql("segment"))
def q_dash_segment_share(spark, sf):
    return kpi.dash_segment_share(raw_fact(spark, sf, [S.segment, S.sales]))


@register("dash_category_profit", O.on_raw(f"""
SELECT category, {M('profit')} AS profit FROM fact WHERE category IS NOT NULL
GROUP BY category ORDER BY category"""))
def q_dash_category_profit(spark, sf):
    return kpi.dash_category_profit(raw_fact(spark, sf, [S.category, S.profit]))


@register("dash_segment_profit", O.on_raw(f"""
SELECT segment, {M('profit')} AS profit FROM fact WHERE segment IS NOT NULL
GROUP BY segment ORDER BY segment"""))
def q_dash_segment_profit(spark, sf):
    return kpi.dash_segment_profit(raw_fact(spark, sf, [S.segment, S.profit]))


_SUB_SQL = f"""
, sub AS (SELECT sub_category, {M('sales')} AS sales, {M('profit')} AS profit,
     {M('quantity')} AS quantity FROM fact WHERE sub_category IS NOT NULL GROUP BY sub_category)
, subm AS (SELECT *, {MG()} AS profit_margin, {R('sales', 'profit')} AS sales_to_profit_ratio
     FROM sub)
"""


@register("dash_top_subcategory_sales", O.on_raw(_SUB_SQL + """
SELECT sub_category, sales FROM subm ORDER BY sales DESC, sub_category LIMIT 10"""))
def q_dash_top_subcategory_sales(spark, sf):
    return kpi.dash_top_subcategory_sales(raw_fact(spark, sf, [S.sub_category, S.sales,
                                                               S.profit, S.quantity]))


@register("dash_top_subcategory_margin", O.on_raw(_SUB_SQL + """
SELECT sub_category, sales, profit, profit_margin FROM subm
ORDER BY profit_margin DESC NULLS LAST, sub_category LIMIT 10"""))
def q_dash_top_subcategory_margin(spark, sf):
    return kpi.dash_top_subcategory_margin(raw_fact(spark, sf, [S.sub_category, S.sales,
                                                                S.profit, S.quantity]))


@register("dash_subcategory_bubble", O.on_raw(_SUB_SQL + """
SELECT * FROM subm ORDER BY sub_category"""))
def q_dash_subcategory_bubble(spark, sf):
    return kpi.dash_subcategory_bubble(raw_fact(spark, sf, [S.sub_category, S.sales,
                                                            S.profit, S.quantity]))


@register("dash_breakeven_line", O.on_raw(_SUB_SQL + """
SELECT max(sales) AS max_sales, max(sales) * 0.8 AS label_x FROM subm"""))
def q_dash_breakeven_line(spark, sf):
    return kpi.dash_breakeven_line(raw_fact(spark, sf, [S.sub_category, S.sales,
                                                        S.profit, S.quantity]))


@register("dash_segment_aov", O.on_raw("""
, o AS (SELECT segment, order_id, SUM(CAST(sales AS DECIMAL(18,4))) AS s FROM fact
        WHERE segment IS NOT NULL AND order_id IS NOT NULL GROUP BY segment, order_id)
SELECT segment, CAST(SUM(s) AS DOUBLE) / NULLIF(CAST(COUNT(*) AS DOUBLE), 0)
       AS average_order_value
FROM o GROUP BY segment ORDER BY segment"""))
def q_dash_segment_aov(spark, sf):
    return kpi.dash_segment_aov(raw_fact(spark, sf, [S.segment, S.order_id, S.sales]))


@register("dash_segment_margin", O.on_raw(f"""
SELECT segment, {M('sales')} AS sales, {M('profit')} AS profit,
       {MG(M('profit'), M('sales'))} AS profit_margin
FROM fact WHERE segment IS NOT NULL GROUP BY segment ORDER BY segment"""))
def q_dash_segment_margin(spark, sf):
    return kpi.dash_segment_margin(raw_fact(spark, sf, [S.segment, S.sales, S.profit]))


@register("dash_state_margin", O.on_raw(f"""
, st AS (SELECT state, {M('sales')} AS sales, {M('profit')} AS profit,
       {MG(M('profit'), M('sales'))} AS profit_margin
  FROM fact WHERE state IS NOT NULL GROUP BY state)
SELECT *, CASE WHEN profit_margin < -10.0 THEN -10.0 WHEN profit_margin > 30.0 THEN 30.0
               ELSE profit_margin END AS margin_color
FROM st ORDER BY state"""))
def q_dash_state_margin(spark, sf):
    return kpi.dash_state_margin(raw_fact(spark, sf, [S.state, S.sales, S.profit]))


@register("dash_day_of_week", O.on_raw(f"""
SELECT dayname(order_date) AS day_of_week, isodow(order_date) - 1 AS day_of_week_ordinal,
       {M('sales')} AS sales, {M('profit')} AS profit, COUNT(DISTINCT order_id) AS order_count,
       {MG(M('profit'), M('sales'))} AS profit_margin
FROM fact WHERE order_date IS NOT NULL GROUP BY 1, 2 ORDER BY 2"""))
def q_dash_day_of_week(spark, sf):
    return kpi.dash_day_of_week(raw_fact(spark, sf, [S.order_date, S.sales, S.profit,
                                                     S.order_id]))


@register("dash_month_of_year", O.on_raw(f"""
SELECT monthname(order_date) AS month_of_year, month(order_date) AS month_of_year_ordinal,
       {M('sales')} AS sales, {M('profit')} AS profit, COUNT(DISTINCT order_id) AS order_count,
       {MG(M('profit'), M('sales'))} AS profit_margin
FROM fact WHERE order_date IS NOT NULL GROUP BY 1, 2 ORDER BY 2"""))
def q_dash_month_of_year(spark, sf):
    return kpi.dash_month_of_year(raw_fact(spark, sf, [S.order_date, S.sales, S.profit,
                                                       S.order_id]))


# Long forms for line/bar charts ------------------------------------------------

@register("dash_trend_long", O.on_raw(f"""
, m AS (SELECT strftime(order_date, '%Y-%m') AS month, {M('sales')} AS sales,
       {M('profit')} AS profit FROM fact WHERE order_date IS NOT NULL GROUP BY 1)
SELECT month, 'sales' AS metric, sales AS value, 'Sales' AS title FROM m
UNION ALL SELECT month, 'profit', profit, 'Profit' FROM m"""))
def q_dash_trend_long(spark, sf):
    m = kpi.to_long(q_dash_monthly_trend(spark, sf), ["month"], ["sales", "profit"])
    return m.withColumn("title", title_label("metric"))


@register("top_subcategories", O.on_prepared(f"""
SELECT category, sub_category, {M('sales')} AS sales, printf('$%.2f', {M('sales')}) AS sales_text
FROM prepared WHERE category IS NOT NULL AND sub_category IS NOT NULL
GROUP BY category, sub_category ORDER BY sales DESC, category, sub_category LIMIT 10"""))
def q_top_subcategories(spark, sf):
    top = kpi.top_k(q_subcategory_performance(spark, sf), 10, "sales", [S.category, S.sub_category])
    return top.select(S.category, S.sub_category, "sales", currency("sales").alias("sales_text"))


@register("top_states", O.on_prepared(f"""
SELECT state, {M('sales')} AS sales, {M('profit')} AS profit
FROM prepared WHERE state IS NOT NULL GROUP BY state ORDER BY sales DESC, state LIMIT 15"""))
def q_top_states(spark, sf):
    top = kpi.top_k(q_state_performance(spark, sf), 15, "sales", [S.state])
    return top.select(S.state, "sales", "profit")


@register("chart_monthly_long", O.on_prepared(f"""
, m AS (SELECT strftime(order_date, '%Y-%m') AS month, {M('sales')} AS sales,
       {M('profit')} AS profit FROM prepared WHERE order_date IS NOT NULL GROUP BY 1)
SELECT month, 'sales' AS metric, sales AS value FROM m
UNION ALL SELECT month, 'profit', profit FROM m"""))
def q_chart_monthly_long(spark, sf):
    m = q_monthly_sales(spark, sf)
    return kpi.to_long(m, ["month"], ["sales", "profit"])


@register("chart_segment_long", O.on_prepared(f"""
, s AS (SELECT segment,
       {R(M('sales'), 'COUNT(DISTINCT customer_id)')} AS sales_per_customer,
       {R(M('profit'), 'COUNT(DISTINCT customer_id)')} AS profit_per_customer
   FROM prepared WHERE segment IS NOT NULL GROUP BY segment)
SELECT segment, 'sales_per_customer' AS metric, sales_per_customer AS value FROM s
UNION ALL SELECT segment, 'profit_per_customer', profit_per_customer FROM s"""))
def q_chart_segment_long(spark, sf):
    s = q_segment_performance(spark, sf)
    return kpi.to_long(s, [S.segment], ["sales_per_customer", "profit_per_customer"])


# ---------------------------------------------------------------------------
# Monthly series, windows, features, folds, horizon rows
# ---------------------------------------------------------------------------

_SERIES_COLS = [S.order_date, S.sales, S.profit, S.quantity, S.discount, S.order_id]
_BASE = ["year", "month", "date", "sales", "profit", "quantity", "avg_discount", "order_count"]


def _fc_frame(spark, sf, keys=()):
    """The forecaster's prepared frame (extra date parts), narrowed."""
    return prepared_fact(spark, sf, list(keys) + _SERIES_COLS, extra_parts=True)


def _cmp(df: DataFrame) -> DataFrame:
    """Round engine-dependent last bits for comparison (see oracle_sql.rounded)."""
    out = []
    for c in df.columns:
        if "_std_" in c:
            out.append(F.round(c, 2).alias(c))
        elif c in ("month_sin", "month_cos"):
            out.append((F.round(c, 10) + F.lit(0.0)).alias(c))  # + 0.0: no -0.0
        else:
            out.append(F.col(c))
    return df.select(*out)


def _sel(cols):
    return ", ".join(O.rounded(c) for c in cols)


@register("monthly_series", O.on_prepared(O.monthly_cte() + f"SELECT {_sel(_BASE)} FROM ms",
                                          extra_parts=True))
def q_monthly_series(spark, sf):
    return series.public(series.monthly_series(_fc_frame(spark, sf)))


@register("category_monthly_panel", O.on_prepared(
    O.monthly_cte(("category",)) + f"SELECT category, {_sel(_BASE)} FROM ms", extra_parts=True))
def q_category_monthly_panel(spark, sf):
    return series.public(series.monthly_series(_fc_frame(spark, sf, [S.category]), [S.category]))


_GLAGS = [f"{c}_lag_{k}" for k in series.GLOBAL_LAGS for c in series.GLOBAL_LAG_MEASURES]
_CLAGS = [f"{c}_lag_{k}" for k in series.CATEGORY_LAGS for c in series.CATEGORY_LAG_MEASURES]
_GROLL = [f"sales_rolling_{s}_{w}" for w in series.GLOBAL_WINDOWS for s in ("mean", "std")]
_CROLL = [f"sales_rolling_mean_{w}" for w in series.CATEGORY_WINDOWS]


@register("monthly_lags", O.on_prepared(O.GLOBAL_FEAT + f"SELECT date, {_sel(_GLAGS)} FROM feat",
                                        extra_parts=True))
def q_monthly_lags(spark, sf):
    m = series.monthly_series(_fc_frame(spark, sf))
    m = series.add_lags(m, series.GLOBAL_LAGS, series.GLOBAL_LAG_MEASURES)
    return m.select("date", *_GLAGS)


@register("category_lags", O.on_prepared(
    O.CATEGORY_FEAT + f"SELECT category, date, {_sel(_CLAGS)} FROM feat", extra_parts=True))
def q_category_lags(spark, sf):
    k = [S.category]
    m = series.monthly_series(_fc_frame(spark, sf, k), k)
    m = series.add_lags(m, series.CATEGORY_LAGS, series.CATEGORY_LAG_MEASURES, k)
    return m.select(S.category, "date", *_CLAGS)


@register("monthly_rolling", O.on_prepared(
    O.GLOBAL_FEAT + f"SELECT date, {_sel(_GROLL)} FROM feat", extra_parts=True))
def q_monthly_rolling(spark, sf):
    m = series.monthly_series(_fc_frame(spark, sf))
    return _cmp(series.add_rolling(m, series.GLOBAL_WINDOWS, True).select("date", *_GROLL))


@register("category_rolling", O.on_prepared(
    O.CATEGORY_FEAT + f"SELECT category, date, {_sel(_CROLL)} FROM feat", extra_parts=True))
def q_category_rolling(spark, sf):
    k = [S.category]
    m = series.monthly_series(_fc_frame(spark, sf, k), k)
    return series.add_rolling(m, series.CATEGORY_WINDOWS, False, k).select(S.category, "date",
                                                                            *_CROLL)


@register("cyclical_month", O.on_prepared(
    O.GLOBAL_FEAT + f"SELECT date, month, {_sel(['month_sin', 'month_cos'])} FROM feat",
    extra_parts=True))
def q_cyclical_month(spark, sf):
    m = series.add_cyclical(series.monthly_series(_fc_frame(spark, sf)))
    return _cmp(m.select("date", "month", "month_sin", "month_cos"))


_GFEAT_COLS = _BASE + _GLAGS + _GROLL + ["month_sin", "month_cos"]
_CFEAT_COLS = ["category"] + _BASE + _CLAGS + _CROLL + ["month_sin", "month_cos"]


@register("monthly_features", O.on_prepared(
    O.GLOBAL_FEAT + f"SELECT {_sel(_GFEAT_COLS)} FROM feat_clean", extra_parts=True))
def q_monthly_features(spark, sf):
    return _cmp(series.public(series.monthly_features(_fc_frame(spark, sf))))


@register("category_features", O.on_prepared(
    O.CATEGORY_FEAT + f"SELECT {_sel(_CFEAT_COLS)} FROM feat_clean", extra_parts=True))
def q_category_features(spark, sf):
    return _cmp(series.public(series.category_features(_fc_frame(spark, sf, [S.category]))))


@register("ts_folds", O.on_prepared(O.GLOBAL_FEAT + """
, f AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS rn, count(*) OVER () AS n
        FROM feat_clean)
, x AS (SELECT f.*, fold, n // 6 AS t, n - (5 - fold) * (n // 6) AS start
        FROM f, range(0, 5) r(fold) WHERE n // 6 >= 1)
SELECT date, fold, CASE WHEN rn < start THEN 'train' ELSE 'test' END AS role,
       start AS train_size, t AS test_size
FROM x WHERE rn < start + t""", extra_parts=True))
def q_ts_folds(spark, sf):
    return series.ts_folds(series.monthly_features(_fc_frame(spark, sf)))


@register("future_dates", O.on_prepared(O.GLOBAL_FEAT + """
, last AS (SELECT max(date) AS d FROM feat_clean)
SELECT i AS step, CAST(d + INTERVAL (30 * i) DAY AS DATE) AS date,
       CAST(d + INTERVAL (i) MONTH AS DATE) AS calendar_date
FROM last, range(1, 7) r(i)""", extra_parts=True))
def q_future_dates(spark, sf):
    f = series.monthly_features(_fc_frame(spark, sf))
    last = f.agg(F.max("date").alias("d"))
    return last.select(F.posexplode(F.arrays_zip(
        series.future_dates(F.col("d"), 6, "30d").alias("date"),
        series.future_dates(F.col("d"), 6, "month").alias("calendar_date"))).alias("i", "z")) \
        .select((F.col("i") + 1).cast("bigint").alias("step"), "z.date", "z.calendar_date")


def _steps_sql(keys, lags, measures, windows, with_std, full_window, src) -> tuple[str, list]:
    """CTEs up to ``steps`` (the horizon rows) and the names of their features."""
    k = "".join(f"{c}, " for c in keys)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    aggs = ["max(date) AS last_date", "avg(avg_discount) AS avg_discount"]
    for lag in lags:
        for c in measures:
            aggs.append(f"COALESCE(max(CASE WHEN rd = {lag} THEN {c} END), 0.0) AS {c}_lag_{lag}")
    feats = [f"{c}_lag_{lag}" for lag in lags for c in measures]
    for w in windows:
        full = f"count(CASE WHEN rd <= {w} THEN 1 END) = {w}"
        dflt = "0.0" if full_window else "NULL"
        aggs.append(f"CASE WHEN {full} THEN CAST(SUM(CASE WHEN rd <= {w} THEN sales_dec END)"
                    f" AS DOUBLE) / {w}.0 ELSE {dflt} END AS sales_rolling_mean_{w}")
        feats.append(f"sales_rolling_mean_{w}")
        if with_std:
            aggs.append(f"CASE WHEN {full} THEN stddev_samp(CASE WHEN rd <= {w} THEN sales END)"
                        f" ELSE {dflt} END AS sales_rolling_std_{w}")
            feats.append(f"sales_rolling_std_{w}")
    grp = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""
, r AS (SELECT *, row_number() OVER ({part}ORDER BY date DESC) AS rd FROM {src})
, last AS (SELECT {k}{', '.join(aggs)} FROM r {grp})
, steps AS (SELECT last.*, i AS step, CAST(last_date + INTERVAL (30 * i) DAY AS DATE) AS date
            FROM last, range(1, 7) r(i))
""", feats


def _future_sql(keys, *args) -> str:
    ctes, feats = _steps_sql(keys, *args)
    k = "".join(f"{c}, " for c in keys)
    return ctes + f"""
SELECT {k}step, date, year(date) AS year, month(date) AS month, avg_discount,
       {', '.join(O.rounded(f) for f in feats)},
       round(sin(2 * pi() * month(date) / 12), 10) + 0.0 AS month_sin,
       round(cos(2 * pi() * month(date) / 12), 10) + 0.0 AS month_cos
FROM steps"""


@register("future_features", O.on_prepared(O.GLOBAL_FEAT + _future_sql(
    (), series.GLOBAL_LAGS, series.GLOBAL_LAG_MEASURES, series.GLOBAL_WINDOWS, True, False,
    "feat_clean"), extra_parts=True))
def q_future_features(spark, sf):
    f = series.monthly_features(_fc_frame(spark, sf))
    return _cmp(series.future_features(f, 6))


@register("category_future_features", O.on_prepared(O.CATEGORY_FEAT + _future_sql(
    ("category",), series.CATEGORY_LAGS, series.CATEGORY_LAG_MEASURES, series.CATEGORY_WINDOWS,
    False, True, "feat_clean"), extra_parts=True))
def q_category_future_features(spark, sf):
    k = [S.category]
    f = series.category_features(_fc_frame(spark, sf, k))
    return _cmp(series.future_features(
        f, 6, k, series.CATEGORY_LAGS, series.CATEGORY_LAG_MEASURES, series.CATEGORY_WINDOWS,
        with_std=False, require_full_window=True))


# ---------------------------------------------------------------------------
# Models: split, scaling, encoding, metrics (exact) and fits (rows-only)
# ---------------------------------------------------------------------------

_MODEL_NUM = ["quantity", "discount", "order_year", "order_month", "order_quarter",
              "order_dayofweek", "ship_year", "ship_month", "ship_quarter", "ship_dayofweek"]
_MODEL_CAT = ["ship_mode", "segment", "region", "state", "category", "sub_category"]
_TEST = ("CAST(('0x' || substr(md5(CAST(row_id AS VARCHAR)), 1, 8)) AS BIGINT) % 5 = 0")


@register("train_test_split", O.on_raw(f"SELECT row_id, {_TEST} AS is_test FROM fact"))
def q_train_test_split(spark, sf):
    f = raw_fact(spark, sf, [S.row_id])
    return f.select(S.row_id, ml.is_test_row(S.row_id).alias("is_test"))


def _std_rows_sql() -> str:
    parts = []
    for c in _MODEL_NUM:
        x = f"CAST({c} AS DECIMAL(18,4))"
        parts.append(f"""SELECT '{c}' AS feature,
    CAST(SUM({x}) AS DOUBLE) / CAST(COUNT({x}) AS DOUBLE) AS mean,
    COALESCE(NULLIF(sqrt(CAST(COUNT({x}) * SUM({x} * {x}) - SUM({x}) * SUM({x}) AS DOUBLE)
         / CAST(COUNT({x}) AS DOUBLE) / CAST(COUNT({x}) AS DOUBLE)), 0), 1.0) AS std
  FROM prepared WHERE NOT ({_TEST})""")
    return "\nUNION ALL ".join(parts)


@register("standardized_features", O.on_prepared(
    f"SELECT feature, mean, round(std, 9) AS std FROM ({_std_rows_sql()})"))
def q_standardized_features(spark, sf):
    p = prepared_fact(spark, sf, [S.row_id, S.quantity, S.discount, S.order_date, S.ship_date])
    train = p.where(~ml.is_test_row(S.row_id))
    params = ml.standardize_params(train, _MODEL_NUM)
    rows = [(c, params[c][0], params[c][1]) for c in _MODEL_NUM]
    return spark.createDataFrame(rows, "feature string, mean double, std double").select(
        "feature", "mean", F.round("std", 9).alias("std"))


def _levels_sql() -> str:
    """Vocabulary ``l`` of the training rows: feature, level, slot, rows."""
    parts = " UNION ALL\n".join(
        f"SELECT '{c}' AS feature, {c} AS level, COUNT(*) AS rows FROM prepared "
        f"WHERE {c} IS NOT NULL AND NOT ({_TEST}) GROUP BY {c}" for c in _MODEL_CAT)
    return f"""
, l AS (SELECT feature, level, row_number() OVER (PARTITION BY feature ORDER BY level) - 1 AS slot,
               rows FROM ({parts}))"""


@register("one_hot_counts", O.on_prepared(_levels_sql() + "\nSELECT * FROM l"))
def q_one_hot_counts(spark, sf):
    p = prepared_fact(spark, sf, [S.row_id] + _MODEL_CAT)
    return ml.one_hot_levels(p.where(~ml.is_test_row(S.row_id)), _MODEL_CAT)


def _scaled_sql() -> str:
    z = ", ".join(f"""round((CAST({c} AS DOUBLE) - (SELECT mean FROM s WHERE feature = '{c}'))
    / (SELECT std FROM s WHERE feature = '{c}'), 6) + 0.0 AS {c}""" for c in _MODEL_NUM)
    return O.on_prepared(f", s AS ({_std_rows_sql()})\nSELECT row_id, {z} FROM prepared")


@register("standardized_rows", _scaled_sql())
def q_standardized_rows(spark, sf):
    """Every order line's scaled numeric features (parameters of the training rows)."""
    p = prepared_fact(spark, sf, [S.row_id, S.quantity, S.discount, S.order_date, S.ship_date])
    params = ml.standardize_params(p.where(~ml.is_test_row(S.row_id)), _MODEL_NUM)
    z = p.select(S.row_id, *ml.standardized(_MODEL_NUM, params))
    return z.select(S.row_id, *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in _MODEL_NUM])


def _encoded_sql() -> str:
    joins = "\n".join(f"LEFT JOIN l AS l_{c} ON l_{c}.feature = '{c}' AND l_{c}.level = p.{c}"
                      for c in _MODEL_CAT)
    return O.on_prepared(_levels_sql() + f"""
SELECT p.row_id, {', '.join(f"l_{c}.slot AS {c}" for c in _MODEL_CAT)}
FROM prepared p
{joins}""")


@register("one_hot_rows", _encoded_sql())
def q_one_hot_rows(spark, sf):
    """The hot slot of every order line's encoded categoricals (null: all zeros,
    a level the training rows do not hold)."""
    p = prepared_fact(spark, sf, [S.row_id] + _MODEL_CAT)
    encoder = ml.one_hot_encoder(_MODEL_CAT).fit(p.where(~ml.is_test_row(S.row_id)))
    hot = encoder.transform(p)
    slot = lambda c: F.array_position(vector_to_array(f"{c}__ohe"), F.lit(1.0))
    return hot.select(S.row_id, *[F.when(slot(c) > 0, slot(c) - 1).alias(c) for c in _MODEL_CAT])


@register("regression_metrics", O.on_prepared(O.GLOBAL_FEAT + """
, e AS (SELECT sales - sales_lag_1 AS e, sales FROM feat_clean)
SELECT COUNT(*) AS n, round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse,
       round(1.0 - sum(e * e) / (var_pop(sales) * COUNT(*)), 9) AS r2
FROM e""", extra_parts=True))
def q_regression_metrics(spark, sf):
    """Scores the naive last-month forecast (prediction = sales_lag_1)."""
    f = series.monthly_features(_fc_frame(spark, sf))
    m = ml.regression_metrics(f, "sales", "sales_lag_1")
    return m.select("n", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"),
                    F.round("r2", 9).alias("r2"))


# An explicit choice of these queries, not of the operator: at its default depth
# 30 and 256 bins a fit takes over four minutes on 6,000 lines already (README).
SALES_MODEL = {"max_depth": 8, "max_bins": 32}


def _sales_model(spark, sf):
    return fitted_once(spark, sf, ("sales_model", sf.rstrip("/"), S),
                       lambda: ml.fit_sales_model(prepared_fact(spark, sf), **SALES_MODEL))


@register("sales_model_features", O.on_prepared(_levels_sql() + f"""
SELECT row_number() OVER (ORDER BY c, slot) - 1 AS slot, name AS feature
FROM (SELECT i AS c, 0 AS slot, {_MODEL_NUM!r}[i] AS name FROM range(1, {len(_MODEL_NUM) + 1}) r(i)
      UNION ALL SELECT 100 + list_position({_MODEL_CAT!r}, feature), slot, feature || '_' || level FROM l)"""))
def q_sales_model_features(spark, sf):
    """The slots of the sales model's input, as its fitted stages name them."""
    p = prepared_fact(spark, sf)
    num, cat = ml.model_inputs(p)
    p = p.select(S.row_id, *cat, *[F.col(c).cast("double").alias(f"{c}__z") for c in num])
    encoder = ml.sales_encoding(num, cat).fit(p.where(~ml.is_test_row(S.row_id)))
    names = ml.feature_names(encoder.transform(p))
    return spark.createDataFrame(list(enumerate(names)), "slot bigint, feature string")


@register("sales_model_metrics")
def q_sales_model_metrics(spark, sf):
    return _sales_model(spark, sf).metrics


@register("sales_model_importance")
def q_sales_model_importance(spark, sf):
    return _sales_model(spark, sf).importance.orderBy(F.col("importance").desc(), "feature")


def _global_rows(spark, sf):
    """Monthly features (checkpointed: one row per month) and their horizon."""
    f = fitted_once(spark, sf, ("global_rows", sf.rstrip("/"), S), lambda: ml.materialize(
        series.monthly_features(_fc_frame(spark, sf)), single=True))
    return f, series.future_features(f, 6)


def _global_fits(spark, sf):
    """Monthly features and every fit of the three candidates: 5 CV folds each
    plus a refit scoring the 6-step horizon."""
    f, fut = _global_rows(spark, sf)
    return f, fitted_once(spark, sf, ("global_fits", sf.rstrip("/"), S), lambda: ml.materialize(
        forecast.series_fits(f, fut), single=True))


def _category_rows(spark, sf):
    """The same for each category."""
    k = [S.category]
    f = fitted_once(spark, sf, ("category_rows", sf.rstrip("/"), S), lambda: ml.materialize(
        series.category_features(_fc_frame(spark, sf, k))))
    return f, series.future_features(
        f, 6, k, series.CATEGORY_LAGS, series.CATEGORY_LAG_MEASURES, series.CATEGORY_WINDOWS,
        with_std=False, require_full_window=True)


def _category_fits(spark, sf):
    """A linear regression per category: folds with < 5 train or < 2 test rows
    are skipped; a category without a scored fold gets no model."""
    f, fut = _category_rows(spark, sf)
    return f, forecast.linear_fits(f, fut, [S.category], min_train=5, min_test=2)


@register("model_comparison")
def q_model_comparison(spark, sf):
    s = ml.cv_summary(_global_fits(spark, sf)[1])
    return s.withColumn("mean_rmse_text", currency("mean_rmse"))


@register("model_cv_scores")
def q_model_cv_scores(spark, sf):
    fits = _global_fits(spark, sf)[1]
    return fits.where(F.col("fold") >= 0).select("model", "fold", "train_size", "test_size",
                                                  "rmse")


@register("forecast_feature_importance")
def q_forecast_feature_importance(spark, sf):
    imp = ml.selected_importance(_global_fits(spark, sf)[1])
    return imp.orderBy(F.col("importance").desc(), "feature")


@register("sales_forecast")
def q_sales_forecast(spark, sf):
    return ml.selected_forecast(_global_fits(spark, sf)[1])


@register("history_plus_forecast")
def q_history_plus_forecast(spark, sf):
    f, fits = _global_fits(spark, sf)
    return ml.history_plus_forecast(f, ml.selected_forecast(fits))


# ---------------------------------------------------------------------------
# Closed-form predictors through the same folds, selection and forecasts
# (exact), and the columns of the fitted forecasts that depend on no fit
# ---------------------------------------------------------------------------

_PREDICTORS = {"last_month": "sales_lag_1", "mean_3": "sales_rolling_mean_3"}


def _predictor_sql(keys: tuple[str, ...] = (), min_train: int = 0, min_test: int = 0) -> str:
    """CTEs scores, summary and told (the selected predictor's horizon)."""
    k = "".join(f"{c}, " for c in keys)
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    values = ", ".join(f"('{m}', {c})" for m, c in _PREDICTORS.items())
    ordinal = " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(_PREDICTORS))
    on = f"USING ({', '.join([*keys, 'model'])})"
    if keys:
        steps, _ = _steps_sql(keys, series.CATEGORY_LAGS, series.CATEGORY_LAG_MEASURES,
                              series.CATEGORY_WINDOWS, False, True, "feat_clean")
    else:
        steps, _ = _steps_sql(keys, series.GLOBAL_LAGS, series.GLOBAL_LAG_MEASURES,
                              series.GLOBAL_WINDOWS, True, False, "feat_clean")
    return (O.CATEGORY_FEAT if keys else O.GLOBAL_FEAT) + steps + f"""
, numbered AS (SELECT *, row_number() OVER ({part} ORDER BY date) - 1 AS rn,
                      count(*) OVER ({part}) AS cnt FROM feat_clean)
, folds AS (SELECT numbered.*, fold, cnt // 6 AS t, cnt - (5 - fold) * (cnt // 6) AS start
            FROM numbered, range(0, 5) f(fold) WHERE cnt // 6 >= 1)
, tested AS (SELECT {k}fold, start, t, sales, model, prediction
             FROM folds, LATERAL (VALUES {values}) p(model, prediction)
             WHERE rn >= start AND rn < start + t AND start >= {min_train} AND t >= {min_test})
, scores AS (SELECT {k}model, CAST(fold AS INTEGER) AS fold, CAST(start AS INTEGER) AS train_size,
                    CAST(t AS INTEGER) AS test_size,
                    sqrt(avg((sales - prediction) * (sales - prediction))) AS rmse
             FROM tested GROUP BY ALL)
, means AS (SELECT {k}model, CAST(count(rmse) AS INTEGER) AS folds_scored, avg(rmse) AS mean_rmse
            FROM scores GROUP BY {k}model)
, summary AS (SELECT *, row_number() OVER ({part} ORDER BY mean_rmse,
                     CASE model {ordinal} END) = 1 AS selected FROM means)
, told AS (SELECT {k}model, step, date, strftime(date, '%B %Y') AS label,
                  prediction AS forecasted_sales
           FROM (SELECT {k}step, date, model, prediction
                 FROM steps, LATERAL (VALUES {values}) p(model, prediction)) AS ahead
           JOIN (SELECT {k}model FROM summary WHERE selected) AS best {on}
           WHERE prediction IS NOT NULL)
"""


_SUMMARY_SQL = ("model, folds_scored, round(mean_rmse, 2) AS mean_rmse, selected, "
                "printf('$%.2f', round(mean_rmse, 2)) AS mean_rmse_text FROM summary")


def _summary(fits: DataFrame, keys=()) -> DataFrame:
    s = ml.cv_summary(fits, keys, tuple(_PREDICTORS)).withColumn("mean_rmse", F.round("mean_rmse", 2))
    return s.withColumn("mean_rmse_text", currency("mean_rmse"))


def _global_predictors(spark, sf):
    f, fut = _global_rows(spark, sf)
    return f, forecast.predictor_fits(f, fut, _PREDICTORS)


def _category_predictors(spark, sf):
    f, fut = _category_rows(spark, sf)
    return f, forecast.predictor_fits(f, fut, _PREDICTORS, [S.category], min_train=5, min_test=2)


@register("predictor_cv_scores", O.on_prepared(_predictor_sql() + """
SELECT model, fold, train_size, test_size, round(rmse, 2) AS rmse FROM scores""", extra_parts=True))
def q_predictor_cv_scores(spark, sf):
    fits = _global_predictors(spark, sf)[1].where("fold >= 0")
    return fits.select("model", "fold", "train_size", "test_size", F.round("rmse", 2).alias("rmse"))


@register("predictor_comparison", O.on_prepared(_predictor_sql() + f"SELECT {_SUMMARY_SQL}",
                                                extra_parts=True))
def q_predictor_comparison(spark, sf):
    return _summary(_global_predictors(spark, sf)[1])


@register("predictor_forecast", O.on_prepared(_predictor_sql() + "SELECT * FROM told",
                                              extra_parts=True))
def q_predictor_forecast(spark, sf):
    return _forecast(_global_predictors(spark, sf)[1])


def _forecast(fits: DataFrame, keys=()) -> DataFrame:
    return ml.selected_forecast(fits, keys, tuple(_PREDICTORS))


@register("predictor_history_plus_forecast", O.on_prepared(_predictor_sql() + """
SELECT date, sales, false AS forecast FROM feat_clean
UNION ALL SELECT date, forecasted_sales, true FROM told""", extra_parts=True))
def q_predictor_history_plus_forecast(spark, sf):
    f, fits = _global_predictors(spark, sf)
    return ml.history_plus_forecast(f, _forecast(fits))


@register("category_predictor_comparison", O.on_prepared(
    _predictor_sql(("category",), 5, 2) + f"SELECT category, {_SUMMARY_SQL}", extra_parts=True))
def q_category_predictor_comparison(spark, sf):
    return _summary(_category_predictors(spark, sf)[1], [S.category])


@register("category_predictor_history_plus_forecast", O.on_prepared(
    _predictor_sql(("category",), 5, 2) + """
SELECT category, date, sales, false AS forecast FROM feat_clean
WHERE category IN (SELECT category FROM told)
UNION ALL SELECT category, date, forecasted_sales, true FROM told""", extra_parts=True))
def q_category_predictor_history_plus_forecast(spark, sf):
    f, fits = _category_predictors(spark, sf)
    return ml.history_plus_forecast(f, _forecast(fits, [S.category]), [S.category])


_RULES = {"last_month": [1.0], "mean_3": [1 / 3] * 3, "mean_6": [1 / 6] * 6, "year_ago": [0.0] * 11 + [1.0]}


def _recursive_sql(keys: tuple[str, ...] = ()) -> str:
    k = "".join(f"{c}, " for c in keys)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    rules = ", ".join(f"('{m}', [{', '.join(f'{x!r}::DOUBLE' for x in w)}])" for m, w in _RULES.items())
    body = f"""
, latest AS (SELECT *, row_number() OVER ({part}ORDER BY date DESC) AS rd FROM ms)
, tails AS (SELECT {k}max(date) AS last, list(sales ORDER BY rd) AS tail FROM latest WHERE rd <= 12
            GROUP BY {', '.join(keys) if keys else 'ALL'})
, walk({k}model, w, last, step, tail) AS (
  SELECT {k}model, w, last, 0, tail FROM tails, (VALUES {rules}) r(model, w) WHERE len(tail) >= len(w)
  UNION ALL SELECT {k}model, w, last, step + 1, list_prepend(list_reduce(list_prepend(0.0::DOUBLE,
    list_transform(range(1, len(w) + 1), lambda i: tail[i] * w[i])), lambda a, b: a + b), tail)
  FROM walk WHERE step < 6)
SELECT {k}model, CAST(step AS BIGINT) AS step, CAST(last + INTERVAL (30 * step) DAY AS DATE) AS date,
       round(tail[1], 2) AS forecasted_sales FROM walk WHERE step > 0"""
    return O.on_prepared(O.monthly_cte(keys) + body, extra_parts=True).replace("WITH fact", "WITH RECURSIVE fact", 1)


def _recursive(spark, sf, keys=()):
    m = series.monthly_series(_fc_frame(spark, sf, list(keys)), list(keys))
    told = series.recursive_forecast(m, 6, _RULES, keys)
    return told.withColumn("forecasted_sales", F.round("forecasted_sales", 2))


@register("recursive_forecast", _recursive_sql())
def q_recursive_forecast(spark, sf):
    """Closed-form rules run forward, each step fed with the one before."""
    return _recursive(spark, sf)


@register("category_recursive_forecast", _recursive_sql(("category",)))
def q_category_recursive_forecast(spark, sf):
    return _recursive(spark, sf, [S.category])


@register("model_cv_folds", O.on_prepared(_predictor_sql() + """
SELECT m.model, s.fold, s.train_size, s.test_size, true AS scored
FROM (SELECT DISTINCT fold, train_size, test_size FROM scores) s,
     (VALUES ('random_forest'), ('gradient_boosting'), ('linear_regression')) m(model)""",
                                          extra_parts=True))
def q_model_cv_folds(spark, sf):
    """The folds that the fitted candidates were scored on."""
    fits = _global_fits(spark, sf)[1].where("fold >= 0")
    return fits.select("model", "fold", "train_size", "test_size",
                       F.col("rmse").isNotNull().alias("scored"))


@register("forecast_steps", O.on_prepared(_predictor_sql() + """
SELECT step, date, label, true AS forecasted FROM told""", extra_parts=True))
def q_forecast_steps(spark, sf):
    """Steps, dates and labels of the fitted forecast."""
    return q_sales_forecast(spark, sf).select(
        "step", "date", "label", F.col("forecasted_sales").isNotNull().alias("forecasted"))


# ---------------------------------------------------------------------------
# Linear regressions from product sums: coefficients, folds and forecasts of
# the global series and of every category, against the same elimination in SQL
# ---------------------------------------------------------------------------

_BY_CATEGORY = ("category",)


def _linear_sql(keys: tuple[str, ...], body: str, min_train: int = 0, min_test: int = 0) -> str:
    feats = O.category_feature_list() if keys else O.global_feature_list()
    ctes = (_predictor_sql(keys, min_train, min_test) + O.linear_cte(keys, feats, min_train, min_test)
            + O.linear_scores_cte(keys, len(feats)))
    return O.on_prepared(ctes + body, extra_parts=True).replace("WITH fact", "WITH RECURSIVE fact", 1)


def _digits(c: str) -> Column:
    return F.when(F.col(c).isNotNull(), F.format_string("%.5e", c)).cast("double").alias(c)


def _terms_sql(keys: tuple[str, ...]) -> str:
    k = "".join(f"{c}, " for c in keys)
    names = O.category_feature_list() if keys else O.global_feature_list()
    return f"""
SELECT {k}CAST(fold AS INTEGER) AS fold, term, {O.digits('coefficient')} AS coefficient
FROM (SELECT {k}fold, 'intercept' AS term, intercept AS coefficient FROM linear
      UNION ALL SELECT {k}fold, {names!r}[i], coefs[i] FROM linear, range(1, {len(names) + 1}) r(i))
WHERE coefficient IS NOT NULL"""


@register("linear_coefficients", _linear_sql((), _terms_sql(())))
def q_linear_coefficients(spark, sf):
    """Terms of the linear candidate in every fold (-1: all rows)."""
    f, _ = _global_rows(spark, sf)
    rows = leastsq.coefficient_rows(leastsq.linear_models(f), f)
    return rows.select("fold", "term", _digits("coefficient"))


@register("linear_cv_scores", _linear_sql((), f"""
SELECT fold, train_size, test_size, {O.digits('rmse')} AS rmse FROM linear_scores"""))
def q_linear_cv_scores(spark, sf):
    f, fut = _global_rows(spark, sf)
    fits = forecast.linear_fits(f, fut).where("fold >= 0")
    return fits.select("fold", "train_size", "test_size", _digits("rmse"))


@register("linear_forecast", _linear_sql((), f"""
SELECT step, date, label, {O.digits('forecasted_sales')} AS forecasted_sales FROM linear_told"""))
def q_linear_forecast(spark, sf):
    f, fut = _global_rows(spark, sf)
    return ml.selected_forecast(forecast.linear_fits(f, fut)).select(
        "step", "date", "label", _digits("forecasted_sales"))


@register("category_linear_coefficients", _linear_sql(_BY_CATEGORY, _terms_sql(_BY_CATEGORY), 5, 2))
def q_category_linear_coefficients(spark, sf):
    f, _ = _category_rows(spark, sf)
    models = leastsq.linear_models(f, [S.category], min_train=5, min_test=2)
    return leastsq.coefficient_rows(models, f, [S.category]).select(
        S.category, "fold", "term", _digits("coefficient"))


@register("category_linear_scores", _linear_sql(_BY_CATEGORY, f"""
SELECT category, fold, train_size, test_size, {O.digits('rmse')} AS rmse FROM linear_scores""", 5, 2))
def q_category_linear_scores(spark, sf):
    return _category_fits(spark, sf)[1].where("fold >= 0").select(
        S.category, "fold", "train_size", "test_size", _digits("rmse"))


_CATEGORY_SCORES = """
SELECT category, CAST(count(rmse) AS INTEGER) AS folds_scored, avg(rmse) AS mean_rmse,
       count(rmse) > 0 AS has_model
FROM (SELECT DISTINCT category FROM feat_clean) LEFT JOIN linear_scores USING (category) GROUP BY category"""


@register("category_model_scores", _linear_sql(_BY_CATEGORY, f"""
SELECT * REPLACE ({O.digits('mean_rmse')} AS mean_rmse) FROM ({_CATEGORY_SCORES})""", 5, 2))
def q_category_model_scores(spark, sf):
    f, fits = _category_fits(spark, sf)
    s = ml.cv_summary(fits, [S.category]).drop("selected", "model")
    cats = f.select(S.category).distinct()
    return (cats.join(s, S.category, "left")
            .select(S.category, F.coalesce("folds_scored", F.lit(0)).alias("folds_scored"),
                    _digits("mean_rmse"), (F.coalesce("folds_scored", F.lit(0)) > 0).alias("has_model")))


@register("category_models", _linear_sql(_BY_CATEGORY, f"""
SELECT * EXCLUDE (mean_rmse) FROM ({_CATEGORY_SCORES})""", 5, 2))
def q_category_models(spark, sf):
    """Which categories have a fitted model, from how many folds."""
    return q_category_model_scores(spark, sf).drop("mean_rmse")


def _category_told(spark, sf) -> tuple[DataFrame, DataFrame]:
    f, fits = _category_fits(spark, sf)
    return f, ml.selected_forecast(fits, [S.category])


@register("category_forecast", _linear_sql(_BY_CATEGORY, f"""
SELECT category, 'linear_regression' AS model, step, date, label,
       {O.digits('forecasted_sales')} AS forecasted_sales FROM linear_told""", 5, 2))
def q_category_forecast(spark, sf):
    return _category_told(spark, sf)[1].select(
        S.category, "model", "step", "date", "label", _digits("forecasted_sales"))


@register("category_history_plus_forecast", _linear_sql(_BY_CATEGORY, f"""
SELECT category, date, sales, false AS forecast FROM feat_clean
WHERE category IN (SELECT category FROM linear_told)
UNION ALL SELECT category, date, {O.digits('forecasted_sales')}, true FROM linear_told""", 5, 2))
def q_category_history_plus_forecast(spark, sf):
    f, told = _category_told(spark, sf)
    told = told.withColumn("forecasted_sales", _digits("forecasted_sales"))
    return ml.history_plus_forecast(f, told, [S.category])


def _category_boosted(spark, sf):
    """Gradient boosting per category: folds as in ``_category_fits`` and a refit."""
    f, fut = _category_rows(spark, sf)
    return fitted_once(spark, sf, ("category_boosted", sf.rstrip("/"), S), lambda: ml.materialize(
        forecast.panel_fits(f, fut, S.category, min_train=5, min_test=2), single=True))


@register("category_forecast_steps", O.on_prepared(_predictor_sql(_BY_CATEGORY, 5, 2) + """
SELECT category, 'gradient_boosting' AS model, step, date, label, true AS forecasted FROM told""",
                                                   extra_parts=True))
def q_category_forecast_steps(spark, sf):
    """Steps, dates and labels of each category's forecast by gradient boosting."""
    return ml.selected_forecast(_category_boosted(spark, sf), [S.category]).select(
        S.category, "model", "step", "date", "label",
        F.col("forecasted_sales").isNotNull().alias("forecasted"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle() -> dict[str, str]:
    return dict(ORACLE)


__all__ = ["QUERIES", "ORACLE", "queries", "oracle"]
