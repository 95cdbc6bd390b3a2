"""kpiforge: retail order-line analytics and forecasting as Spark plans.

Layout:
  sources/    parquet star schema -> flat order lines, CSV with encoding
              detection, dataset sinks
  functions/  column expressions (dates, measures)
  operators/  cleaning, statistics, KPI tables, monthly series, ML
  plans/      chart datasets, registered queries, end-to-end pipelines
"""

from .spec import DEFAULT_SPEC, SalesSpec

__all__ = ["DEFAULT_SPEC", "SalesSpec"]
