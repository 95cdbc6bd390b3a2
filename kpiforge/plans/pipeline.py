"""End-to-end runs: read -> clean -> reports, models, forecasts -> datasets.

Intermediate tables (raw and cleaned order lines, feature tables) are written
to the shared checkpoint folder and read back, so every later stage starts
from files rather than re-running the scan and the joins, and a lost executor
only costs the stage it was in. A failing stage (or a failing category inside
the forecasts) is recorded in the status table and the other stages go on.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from functools import cache

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ml, series
from ..operators.forecast import CANDIDATES, linear_fits, series_fits
from ..operators.clean import CleaningStats, parse_dates, prepare
from ..session import scratch_path
from ..sources import read_sales
from ..sources.tables import fact_columns
from ..sources.sinks import catalog, dataset_path, write_table
from ..spec import DEFAULT_SPEC, SalesSpec
from .charts import analysis_datasets, dashboard_datasets, top_features

STAGES = ("analysis", "sales_model", "forecast", "category_forecast", "dashboards")
RECOVERABLE = (PySparkException, Py4JJavaError, ValueError, RuntimeError)


class Run:
    """Bookkeeping of one pipeline run: written datasets and stage status."""

    def __init__(self, spark: SparkSession, out_dir: str, fmt: str = "parquet"):
        self.spark, self.out_dir, self.fmt = spark, out_dir, fmt
        self.work = scratch_path(spark, f"run-{uuid.uuid4().hex[:12]}")
        self.written: list[tuple[str, str, str]] = []
        self.status: list[tuple[str, str | None, bool, str | None]] = []

    def stash(self, df: DataFrame, name: str) -> DataFrame:
        """Write an intermediate table to the shared folder and read it back."""
        path = f"{self.work}/{name}"
        write_table(df, path)
        return self.spark.read.parquet(path)

    def save(self, section: str, name: str, df: DataFrame) -> None:
        path = dataset_path(self.out_dir, name)
        write_table(df, path, self.fmt)
        self.written.append((section, name, path))

    def stage(self, name: str, fn: Callable[[], None], key: str | None = None) -> bool:
        try:
            fn()
        except RECOVERABLE as e:
            msg = f"{type(e).__name__}: {str(e).strip().splitlines()[0][:500] if str(e) else ''}"
            self.status.append((name, key, False, msg))
            return False
        self.status.append((name, key, True, None))
        return True

    def status_frame(self) -> DataFrame:
        return self.spark.createDataFrame(
            self.status, "stage string, key string, ok boolean, message string")


def load(spark: SparkSession, source: str, kind: str = "star",
         spec: SalesSpec = DEFAULT_SPEC) -> DataFrame:
    return read_sales(spark, source, kind, spec)


def run_pipeline(spark: SparkSession, source: str, out_dir: str, kind: str = "star",
                 stages: Iterable[str] = STAGES, horizon: int = 6, fmt: str = "parquet",
                 spec: SalesSpec = DEFAULT_SPEC,
                 sales_model_options: dict | None = None,
                 candidates: Iterable[str] = CANDIDATES) -> tuple[DataFrame, DataFrame]:
    """Run the selected stages; returns (status, catalog) and writes both.
    ``sales_model_options`` go to ``ml.fit_sales_model`` (depth, trees ...),
    ``candidates`` are the models that the global forecast chooses from."""
    run = Run(spark, out_dir, fmt)
    stages = set(stages)

    # Frames are built by the first stage that needs them, inside that stage: a
    # frame that cannot be built fails its stages only.
    @cache
    def raw():
        return run.stash(load(spark, source, kind, spec), "raw")

    @cache
    def stats():
        st = CleaningStats()
        prepare(raw(), spec, dates="coerce", extra_parts="all", stats=st)   # fit once
        return st

    @cache
    def prepared():
        # the analysis raises on an unparseable date ...
        return run.stash(prepare(raw(), spec, dates="strict", stats=stats()), "prepared")

    @cache
    def fc_frame():
        # ... the forecaster turns it into null, and needs few columns
        frame = prepare(raw(), spec, dates="coerce", extra_parts=True, stats=stats())
        wide = set(frame.columns) & set(fact_columns(spec)) - {
            spec.order_date, spec.category, spec.order_id, *spec.capped}
        return run.stash(frame.drop(*wide), "prepared_forecast")

    if "analysis" in stages:
        def analysis():
            for name, df in analysis_datasets(prepared(), spec).items():
                run.save("analysis", name, df)
        run.stage("analysis", analysis)

    if "sales_model" in stages:
        def sales_model():
            m = ml.fit_sales_model(prepared(), spec, **(sales_model_options or {}))
            run.save("model", "sales_model_metrics", m.metrics)
            run.save("model", "feature_importance", top_features(m.importance, 15))
        run.stage("sales_model", sales_model)

    if "forecast" in stages:
        def forecast():
            f = run.stash(series.monthly_features(fc_frame(), spec).drop("_n"),
                          "monthly_features")
            fits = run.stash(series_fits(f, series.future_features(f, horizon), list(candidates)),
                             "global_fits")
            run.save("forecast", "model_comparison", ml.cv_summary(fits))
            run.save("forecast", "global_feature_importance",
                     top_features(ml.selected_importance(fits), 10))
            run.save("forecast", "sales_forecast",
                     ml.history_plus_forecast(f, ml.selected_forecast(fits)))
            for r in fits.where("error is not null").select("model", "fold", "error").collect():
                run.status.append(("forecast", r["model"], False, f"fold {r['fold']}: {r['error']}"))
        run.stage("forecast", forecast)

    if "category_forecast" in stages:
        def category_forecast():
            k = [spec.category]
            f = run.stash(series.category_features(fc_frame(), spec).drop("_n"),
                          "category_features")
            fut = series.future_features(
                f, horizon, k, series.CATEGORY_LAGS, series.CATEGORY_LAG_MEASURES,
                series.CATEGORY_WINDOWS, with_std=False, require_full_window=True)
            fits = run.stash(linear_fits(f, fut, k, min_train=5, min_test=2), "category_fits")
            scores = ml.cv_summary(fits, k)
            run.save("forecast", "category_model_scores", scores)
            run.save("forecast", "category_forecasts",
                     ml.history_plus_forecast(f, ml.selected_forecast(fits, k), k))
            # failed fits and categories without a model are rows of a dataset:
            # there may be as many as categories
            failed = fits.where("error is not null").select(
                *k, F.concat(F.lit("fold "), "fold", F.lit(": "), "error").alias("message"))
            short = (f.select(*k).distinct().join(scores.select(*k), k, "left_anti")
                     .join(failed.select(*k), k, "left_anti")
                     .withColumn("message", F.lit("not enough rows for cross-validation")))
            open_ = run.stash(failed.unionByName(short), "category_status")
            run.save("forecast", "category_status", open_)
            n = open_.count()
            if n:
                run.status.append(("category_forecast", "category_status", False,
                                   f"{n} fits or categories without a model"))
        run.stage("category_forecast", category_forecast)

    if "dashboards" in stages:
        def dashboards():
            # the dashboards read the raw lines, dates coerced (bad -> null)
            for name, df in dashboard_datasets(parse_dates(raw(), spec, "coerce"), spec).items():
                run.save("dashboards", name, df)
        run.stage("dashboards", dashboards)

    cat = catalog(spark, run.written) if run.written else spark.createDataFrame(
        [], "section string, name string, title string, path string")
    write_table(cat, dataset_path(out_dir, "_catalog"), fmt)
    status = run.status_frame()
    write_table(status, dataset_path(out_dir, "_status"), fmt)
    return status, cat


def run_analysis(spark: SparkSession, source: str, out_dir: str, kind: str = "star",
                 **kw) -> tuple[DataFrame, DataFrame]:
    """KPI tables and the row-level sales model."""
    return run_pipeline(spark, source, out_dir, kind, stages=("analysis", "sales_model"), **kw)


def run_forecast(spark: SparkSession, source: str, out_dir: str, kind: str = "star",
                 horizon: int = 6, **kw) -> tuple[DataFrame, DataFrame]:
    """Global and per-category forecasts."""
    return run_pipeline(spark, source, out_dir, kind, horizon=horizon,
                        stages=("forecast", "category_forecast"), **kw)
