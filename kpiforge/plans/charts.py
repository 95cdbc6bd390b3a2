"""Chart-ready datasets: each chart of the reference as a tidy table.

``analysis_datasets`` runs on the cleaned frame (KPI pages), and
``dashboard_datasets`` on the raw frame (the dashboards read the file as
loaded). Both return name -> lazy DataFrame; nothing is computed here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import kpi
from ..spec import DEFAULT_SPEC, SalesSpec


def analysis_datasets(prepared: DataFrame, spec: SalesSpec = DEFAULT_SPEC) -> dict[str, DataFrame]:
    seg = kpi.segment_performance(prepared, spec)
    return {
        "monthly_sales_trends": kpi.to_long(kpi.monthly_sales(prepared, spec), ["month"],
                                            ["sales", "profit"]),
        "monthly_growth": kpi.monthly_growth(prepared, spec),
        "category_performance": kpi.category_performance(prepared, spec),
        "subcategory_performance": kpi.subcategory_performance(prepared, spec),
        "category_analysis": kpi.category_hierarchy(prepared, spec),
        "segment_performance": seg,
        "segment_analysis": kpi.to_long(seg, [spec.segment],
                                        ["sales_per_customer", "profit_per_customer"]),
        "category_ratio": kpi.category_ratio(prepared, spec),
        "regional_performance": kpi.regional_performance(prepared, spec),
        "state_performance": kpi.state_performance(prepared, spec),
        "shipping_performance": kpi.shipping_performance(prepared, spec),
    }


def dashboard_datasets(raw: DataFrame, spec: SalesSpec = DEFAULT_SPEC) -> dict[str, DataFrame]:
    trend = kpi.monthly_sales(raw, spec)
    return {
        "sales_trends_dashboard": kpi.to_long(trend, ["month"], ["sales", "profit"]),
        "category_sales_share": kpi.dash_category_share(raw, spec),
        "category_profit": kpi.dash_category_profit(raw, spec),
        "top_subcategory_sales": kpi.dash_top_subcategory_sales(raw, spec),
        "top_subcategory_margin": kpi.dash_top_subcategory_margin(raw, spec),
        "segment_sales_share": kpi.dash_segment_share(raw, spec),
        "segment_profit": kpi.dash_segment_profit(raw, spec),
        "segment_average_order_value": kpi.dash_segment_aov(raw, spec),
        "segment_margin": kpi.dash_segment_margin(raw, spec),
        "regional_performance_dashboard": kpi.dash_state_margin(raw, spec),
        "profit_analysis_dashboard": kpi.dash_subcategory_bubble(raw, spec),
        "breakeven_line": kpi.dash_breakeven_line(raw, spec),
        "day_of_week_metrics": kpi.dash_day_of_week(raw, spec),
        "month_of_year_metrics": kpi.dash_month_of_year(raw, spec),
    }


def top_features(importance: DataFrame, k: int) -> DataFrame:
    """Importance chart input: the k largest, ties by name."""
    return importance.orderBy(F.col("importance").desc(), "feature").limit(k)
