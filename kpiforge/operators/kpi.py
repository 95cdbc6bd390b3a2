"""Group-by KPI tables over an order-line frame.

Every function takes the frame it reports on (raw or prepared, the caller
decides) and returns a lazy DataFrame. Aggregations are partial+final hash
aggregates on low-cardinality keys; distinct counts are planned by Catalyst
as a two-level aggregate keyed by (group, id), so no group ever gathers its
ids in one task. Rows with a null group key are dropped (pandas semantics).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import day_name, month_key, month_name, weekday0
from ..functions.measures import MONEY, dsum, growth_pct, margin_pct, money_sum, ratio
from ..spec import DEFAULT_SPEC, SalesSpec



def keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop rows whose group key is null (pandas ``groupby`` default)."""
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df if cond is None else df.where(cond)


def spread(df: DataFrame, partitions: int | None, *keys: str | Column) -> DataFrame:
    """``df`` dealt by ``keys`` into ``partitions`` (None: as it lies). Tables of
    nearly as many groups as lines are then built apart from the join before them,
    in tasks whose number follows the input and not the merged sizes of a shuffle."""
    return df if partitions is None else df.repartition(partitions, *keys)


def distinct_count(col: str, exact: bool = True) -> Column:
    """Distinct non-null values: exact (a (group, value) aggregate, shuffles
    one row per distinct pair) or HyperLogLog++ (one pass, a fixed-size
    sketch per group, ~1% relative error) for very large id spaces."""
    c = F.count_distinct(col) if exact else F.approx_count_distinct(col, 0.01)
    return c.cast("bigint")


def _money(spec: SalesSpec) -> list[Column]:
    return [money_sum(spec.sales).alias("sales"),
            money_sum(spec.profit).alias("profit")]


def top_k(df: DataFrame, k: int, by: str, tiebreak: Sequence[str],
          ascending: bool = False) -> DataFrame:
    """Sort by ``by`` (nulls last, like pandas) with a unique tiebreak, keep k."""
    first = F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last()
    return df.orderBy(first, *[F.col(t).asc() for t in tiebreak]).limit(k)


def sort_desc(df: DataFrame, by: str, tiebreak: Sequence[str]) -> DataFrame:
    return df.orderBy(F.col(by).desc_nulls_last(), *[F.col(t).asc() for t in tiebreak])


# --------------------------------------------------------------------------
# Monthly trend (A1, A2) and growth (V1, T6)
# --------------------------------------------------------------------------

def monthly_sales(df: DataFrame, spec: SalesSpec = DEFAULT_SPEC) -> DataFrame:
    """month (YYYY-MM) -> sales, profit, order_count (= order lines)."""
    return (keyed(df.withColumn("month", month_key(spec.order_date)), ["month"])
            .groupBy("month")
            .agg(*_money(spec), F.count(spec.order_id).cast("bigint").alias("order_count"))
            .orderBy("month"))


def monthly_growth(df: DataFrame, spec: SalesSpec = DEFAULT_SPEC) -> DataFrame:
    """Monthly trend plus month-over-month growth % of sales and profit.

    The window has no partition key but runs on the monthly aggregate (one row
    per month), never on order lines.
    """
    m = monthly_sales(df, spec)
    w = Window.orderBy("month")
    out = m
    for c in ("sales", "profit"):
        prev = F.lag(c, 1).over(w)
        out = out.withColumn(f"{c}_growth_rate", growth_pct(F.col(c), prev))
    return out.orderBy("month")


def recent_growth(df: DataFrame, spec: SalesSpec = DEFAULT_SPEC, n: int = 5) -> DataFrame:
    """Last ``n`` months of the growth table (``tail``)."""
    g = monthly_growth(df, spec).select(
        "month", "sales", "sales_growth_rate", "profit", "profit_growth_rate")
    return g.orderBy(F.col("month").desc()).limit(n).orderBy("month")


# --------------------------------------------------------------------------
# Category, segment, region, ship mode (A3-A10)
# --------------------------------------------------------------------------

def category_performance(df: DataFrame, spec: SalesSpec = DEFAULT_SPEC,
                         exact: bool = True, partitions: int | None = None) -> DataFrame:
    lines = spread(keyed(df, [spec.category]), partitions, spec.category, spec.order_id)
    out = (lines.groupBy(spec.category)
           .agg(*_money(spec), money_sum(spec.quantity).alias("quantity"),
                distinct_count(spec.order_id, exact).alias("order_count"))
           .withColumn("profit_margin", margin_pct()))
    return sort_desc(out, "sales", [spec.category])


def subcategory_performance(df: DataFrame, spec: SalesSpec = DEFAULT_SPEC,
                            exact: bool = True, partitions: int | None = None) -> DataFrame:
    keys = [spec.category, spec.sub_category]
    out = (spread(keyed(df, keys), partitions, *keys, spec.order_id).groupBy(*keys)
           .agg(*_money(spec), money_sum(spec.quantity).alias("quantity"),
                distinct_count(spec.order_id, exact).alias("order_count"))
           .withColumn("profit_margin", margin_pct()))
    return sort_desc(out, "sales", keys)


def segment_performance(df: DataFrame, spec: SalesSpec = DEFAULT_SPEC,
                        exact: bool = True) -> DataFrame:
    # one row per order first: the two distinct counts expand these, not the lines
    per_order = (keyed(df, [spec.segment]).groupBy(spec.segment, spec.customer_id, spec.order_id)
                 .agg(dsum(spec.sales).alias(spec.sales), dsum(spec.profit).alias(spec.profit)))
    out = (per_order.groupBy(spec.segment)
           .agg(F.sum(spec.sales).cast("double").alias("sales"),
                F.sum(spec.profit).cast("double").alias("profit"),
                distinct_count(spec.customer_id, exact).alias("customer_count"),
                distinct_count(spec.order_id, exact).alias("order_count"))
           .withColumn("profit_margin", margin_pct())
           .withColumn("sales_per_customer", ratio("sales", "customer_count"))
           .withColumn("profit_per_customer", ratio("profit", "customer_count")))
    return out.orderBy(spec.segment)


def category_ratio(df: DataFrame, spec: SalesSpec = DEFAULT_SPEC) -> DataFrame:
    return (keyed(df, [spec.category]).groupBy(spec.category).agg(*_money(spec))
            .withColumn("profit_margin", margin_pct())
            .withColumn("sales_to_profit_ratio", ratio("sales", "profit"))
            .orderBy(spec.category))


def regional_performance(df: DataFrame, spec: SalesSpec = DEFAULT_SPEC,
                         exact: bool = True) -> DataFrame:
    keys = [spec.region, spec.state]
    out = (keyed(df, keys).groupBy(*keys)
           .agg(*_money(spec),
                distinct_count(spec.order_id, exact).alias("order_count"))
           .withColumn("profit_margin", margin_pct()))
    return sort_desc(out, "sales", keys)


def state_performance(df: DataFrame, spec: SalesSpec = DEFAULT_SPEC) -> DataFrame:
    return (keyed(df, [spec.state]).groupBy(spec.state).agg(*_money(spec))
            .withColumn("profit_margin", margin_pct())
            .orderBy(spec.state))


def shipping_performance(df: DataFrame, spec: SalesSpec = DEFAULT_SPEC,
                         exact: bool = True) -> DataFrame:
    return (keyed(df, [spec.ship_mode]).groupBy(spec.ship_mode)
            .agg(*_money(spec),
                 distinct_count(spec.order_id, exact).alias("order_count"))
            .withColumn("profit_margin", margin_pct())
            .withColumn("avg_order_value", ratio("sales", "order_count"))
            .orderBy(spec.ship_mode))


def category_hierarchy(df: DataFrame, spec: SalesSpec = DEFAULT_SPEC) -> DataFrame:
    """Treemap nodes: (category) and (category, sub_category) with total sales
    and the sales-weighted mean profit. Lines are aggregated to the leaves once;
    the grouping sets roll the leaves up. No grand-total node."""
    cat, sub = spec.category, spec.sub_category
    s = F.col(spec.sales).cast(MONEY)
    # decimal(18,4) x decimal(19,4) keeps the product exact in both engines
    weighted = F.col(spec.profit).cast(MONEY) * F.col(spec.sales).cast("decimal(19,4)")
    leaves = (keyed(df, [cat, sub]).groupBy(cat, sub)
              .agg(F.sum(s).alias("_ls"), F.sum(weighted).alias("_lw")))
    g = (leaves.groupingSets([[cat], [cat, sub]], cat, sub)
         .agg(F.coalesce(F.sum("_ls"), F.lit(0).cast(MONEY)).alias("_s"),
              F.sum("_lw").alias("_w"),
              F.grouping_id().alias("_gid")))
    return (g.select(
        F.when(F.col("_gid") == 1, F.lit("category")).otherwise(F.lit("sub_category"))
        .alias("level"),
        F.col(cat), F.col(sub),
        F.col("_s").cast("double").alias("sales"),
        F.try_divide(F.col("_w").cast("double"), F.col("_s").cast("double"))
        .alias("weighted_profit"))
        .orderBy("level", cat, F.col(sub).asc_nulls_first()))


# --------------------------------------------------------------------------
# Dashboard tables (A11-A22); usually run on the raw frame
# --------------------------------------------------------------------------

def _share(df: DataFrame, key: str, spec: SalesSpec) -> DataFrame:
    """key -> sales and its share of the total in % (pie chart).

    The total is a window over the aggregate (a handful of rows), summed in
    decimal so the share does not depend on row order.
    """
    g = keyed(df, [key]).groupBy(key).agg(dsum(spec.sales).alias("_s"))
    total = F.sum("_s").over(Window.partitionBy())
    return (g.select(key, F.col("_s").cast("double").alias("sales"),
                     (F.try_divide(F.col("_s").cast("double"), total.cast("double"))
                      * F.lit(100.0)).alias("share_pct"))
            .orderBy(key))


def dash_category_share(df: DataFrame, spec: SalesSpec = DEFAULT_SPEC) -> DataFrame:
    return _share(df, spec.category, spec)


def dash_segment_share(df: DataFrame, spec: SalesSpec = DEFAULT_SPEC) -> DataFrame:
    return _share(df, spec.segment, spec)


def _profit_by(df: DataFrame, key: str, spec: SalesSpec) -> DataFrame:
    return (keyed(df, [key]).groupBy(key)
            .agg(money_sum(spec.profit).alias("profit")).orderBy(key))


def dash_category_profit(df: DataFrame, spec: SalesSpec = DEFAULT_SPEC) -> DataFrame:
    return _profit_by(df, spec.category, spec)


def dash_segment_profit(df: DataFrame, spec: SalesSpec = DEFAULT_SPEC) -> DataFrame:
    return _profit_by(df, spec.segment, spec)


def subcategory_totals(df: DataFrame, spec: SalesSpec = DEFAULT_SPEC) -> DataFrame:
    """Sub-category pooled over categories: sales, profit, quantity, margin,
    sales-to-profit ratio. The three sub-category dashboard tables derive from
    this one aggregate."""
    return (keyed(df, [spec.sub_category]).groupBy(spec.sub_category)
            .agg(*_money(spec), money_sum(spec.quantity).alias("quantity"))
            .withColumn("profit_margin", margin_pct())
            .withColumn("sales_to_profit_ratio", ratio("sales", "profit")))


def dash_top_subcategory_sales(df: DataFrame, spec: SalesSpec = DEFAULT_SPEC,
                               k: int = 10) -> DataFrame:
    t = subcategory_totals(df, spec).select(spec.sub_category, "sales")
    return top_k(t, k, "sales", [spec.sub_category])


def dash_top_subcategory_margin(df: DataFrame, spec: SalesSpec = DEFAULT_SPEC,
                                k: int = 10) -> DataFrame:
    t = subcategory_totals(df, spec).select(spec.sub_category, "sales", "profit",
                                            "profit_margin")
    return top_k(t, k, "profit_margin", [spec.sub_category])


def dash_subcategory_bubble(df: DataFrame, spec: SalesSpec = DEFAULT_SPEC) -> DataFrame:
    return subcategory_totals(df, spec).orderBy(spec.sub_category)


def dash_breakeven_line(df: DataFrame, spec: SalesSpec = DEFAULT_SPEC) -> DataFrame:
    """End point of the break-even line: largest sub-category sales, and the
    0.8x position of its label."""
    t = subcategory_totals(df, spec)
    return t.agg(F.max("sales").alias("max_sales")).select(
        "max_sales", (F.col("max_sales") * F.lit(0.8)).alias("label_x"))


def dash_segment_aov(df: DataFrame, spec: SalesSpec = DEFAULT_SPEC) -> DataFrame:
    """Average order value per segment: order totals first, then their mean.

    Level one is keyed by (segment, order); lines with a null order id drop
    out there, as in pandas. A task sums the lines of an order that it holds
    before any exchange, so a hot order leaves it as one row."""
    orders = (keyed(df, [spec.segment, spec.order_id]).groupBy(spec.segment, spec.order_id)
              .agg(dsum(spec.sales).alias("_order_sales")))
    return (orders.groupBy(spec.segment)
            .agg(F.try_divide(F.sum("_order_sales").cast("double"),
                              F.count(F.lit(1)).cast("double"))
                 .alias("average_order_value"))
            .orderBy(spec.segment))


def dash_segment_margin(df: DataFrame, spec: SalesSpec = DEFAULT_SPEC) -> DataFrame:
    return (keyed(df, [spec.segment]).groupBy(spec.segment).agg(*_money(spec))
            .withColumn("profit_margin", margin_pct()).orderBy(spec.segment))


def dash_state_margin(df: DataFrame, spec: SalesSpec = DEFAULT_SPEC,
                      color_range: tuple[float, float] = (-10.0, 30.0)) -> DataFrame:
    """State margin for the map, plus the margin clamped to the colour range
    (null stays null)."""
    lo, hi = color_range
    m = F.col("profit_margin")
    return (state_performance(df, spec)
            .withColumn("margin_color",
                        F.when(m < F.lit(lo), F.lit(lo)).when(m > F.lit(hi), F.lit(hi))
                        .otherwise(m)))


def _calendar_metrics(df: DataFrame, name: Column, ordinal: Column, label: str,
                      spec: SalesSpec, exact: bool = True) -> DataFrame:
    d = df.where(F.col(spec.order_date).isNotNull()).select(
        name.alias(label), ordinal.cast("bigint").alias(f"{label}_ordinal"),
        spec.sales, spec.profit, spec.order_id)
    return (d.groupBy(label, f"{label}_ordinal")
            .agg(*_money(spec),
                 distinct_count(spec.order_id, exact).alias("order_count"))
            .withColumn("profit_margin", margin_pct())
            .orderBy(f"{label}_ordinal"))


def dash_day_of_week(df: DataFrame, spec: SalesSpec = DEFAULT_SPEC,
                     exact: bool = True) -> DataFrame:
    """Weekday metrics, Monday first (ordinal 0 = Monday)."""
    d = F.col(spec.order_date)
    return _calendar_metrics(df, day_name(d), weekday0(d), "day_of_week", spec, exact)


def dash_month_of_year(df: DataFrame, spec: SalesSpec = DEFAULT_SPEC,
                       exact: bool = True) -> DataFrame:
    """Month-of-year metrics pooled over years, January first."""
    d = F.col(spec.order_date)
    return _calendar_metrics(df, month_name(d), F.month(d), "month_of_year", spec, exact)


# --------------------------------------------------------------------------
# Long (tidy) forms for charts
# --------------------------------------------------------------------------

def to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str],
            variable: str = "metric", value: str = "value") -> DataFrame:
    """Wide -> long (one row per id and metric)."""
    cast = df.select(*ids, *[F.col(v).cast("double").alias(v) for v in values])
    return cast.unpivot(list(ids), list(values), variable, value)
