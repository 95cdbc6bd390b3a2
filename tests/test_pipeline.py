"""End-to-end runs, stage isolation and invariants."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from kpiforge.operators import clean, forecast, kpi, leastsq, ml, series
from kpiforge.plans import registry
from kpiforge.plans.frames import prepared_fact, raw_fact
from kpiforge.plans.pipeline import Run, run_analysis, run_forecast, run_pipeline
from kpiforge.sources import read_sales

from sf_paths import SF_SMALL


def test_pipeline_writes_every_dataset(spark):
    out = tempfile.mkdtemp(prefix="pipe-", dir="/tmp")
    status, cat = run_pipeline(spark, SF_SMALL, out,
                               stages=["analysis", "forecast", "category_forecast",
                                       "dashboards"])
    st = status.collect()
    assert all(r["ok"] for r in st), st
    names = {r["name"] for r in cat.collect()}
    assert {"category_performance", "sales_forecast", "category_forecasts",
            "day_of_week_metrics", "model_comparison"} <= names
    for r in cat.collect():
        assert os.path.isdir(r["path"])
    fc = spark.read.parquet(os.path.join(out, "sales_forecast"))
    assert fc.where("forecast").count() == 6
    titles = {r["name"]: r["title"] for r in cat.collect()}
    assert titles["category_performance"] == "Category Performance"


def test_failing_stage_is_isolated(spark):
    run = Run(spark, tempfile.mkdtemp(prefix="pipe-", dir="/tmp"))

    def boom():
        spark.sql("SELECT * FROM no_such_table").collect()
    assert run.stage("broken", boom) is False
    assert run.stage("fine", lambda: None) is True
    rows = run.status_frame().collect()
    assert [r["ok"] for r in rows] == [False, True]
    assert "TABLE_OR_VIEW_NOT_FOUND" in rows[0]["message"]

    def bug():
        raise KeyError("not a recoverable error")
    with pytest.raises(KeyError):
        run.stage("bug", bug)


def test_totals_agree_across_groupings(spark):
    """Sales summed by category, by segment and by month are one total."""
    cols = ["category", "segment", "order_date", "sales", "profit", "quantity", "order_id",
            "customer_id"]
    p = prepared_fact(spark, SF_SMALL, cols)
    by_cat = sum(r["sales"] for r in kpi.category_performance(p).collect())
    by_seg = sum(r["sales"] for r in kpi.segment_performance(p).collect())
    by_month = sum(r["sales"] for r in kpi.monthly_sales(p).collect())
    assert by_cat == pytest.approx(by_seg, rel=1e-12) == pytest.approx(by_month, rel=1e-12)
    shares = [r["share_pct"] for r in kpi.dash_category_share(p).collect()]
    assert sum(shares) == pytest.approx(100.0)


def test_capped_values_within_bounds(spark):
    from kpiforge.plans.frames import cleaning_stats
    st = cleaning_stats(spark, SF_SMALL)
    p = prepared_fact(spark, SF_SMALL, ["sales", "profit", "quantity", "discount"])
    agg = p.agg(*[F.min(c).alias(f"lo_{c}") for c in p.columns],
                *[F.max(c).alias(f"hi_{c}") for c in p.columns]).first()
    for c in p.columns:
        lo, hi = st.bounds[c][2], st.bounds[c][3]
        assert float(agg[f"lo_{c}"]) >= float(lo) - 1e-4
        assert float(agg[f"hi_{c}"]) <= float(hi) + 1e-4
    assert p.count() == raw_fact(spark, SF_SMALL, ["sales"]).count()


def test_fold_train_before_test(spark):
    folds = registry.QUERIES["ts_folds"](spark, SF_SMALL)
    g = folds.groupBy("fold").agg(
        F.max(F.when(F.col("role") == "train", F.col("date"))).alias("train_end"),
        F.min(F.when(F.col("role") == "test", F.col("date"))).alias("test_start")).collect()
    assert len(g) == 5 and all(r["train_end"] < r["test_start"] for r in g)


def test_forecast_queries_shapes(spark):
    q = registry.QUERIES
    assert q["sales_forecast"](spark, SF_SMALL).count() == 6
    cmp = q["model_comparison"](spark, SF_SMALL).collect()
    assert sum(r["selected"] for r in cmp) == 1 and len(cmp) == 3
    cats = q["category_model_scores"](spark, SF_SMALL).collect()
    with_model = [r["category"] for r in cats if r["has_model"]]
    assert q["category_forecast"](spark, SF_SMALL).count() == 6 * len(with_model)


def test_sales_model_metrics_are_sane(spark):
    m = registry.QUERIES["sales_model_metrics"](spark, SF_SMALL).first()
    assert m["n"] > 0 and m["mae"] > 0 and m["rmse"] >= m["mae"] and m["r2"] <= 1.0
    imp = registry.QUERIES["sales_model_importance"](spark, SF_SMALL).collect()
    assert sum(r["importance"] for r in imp) == pytest.approx(1.0)
    assert any(r["feature"].startswith("category_") for r in imp)


def test_csv_export_gives_same_reports(spark):
    """A flat CSV export (reference-style headers, M/d/yyyy dates) run
    through the pipeline gives the same KPI tables as the star schema."""
    src = tempfile.mkdtemp(prefix="csvsrc-", dir="/tmp")
    fact = raw_fact(spark, SF_SMALL)
    headers = {"row_id": "Row ID", "order_id": "Order ID", "order_date": "Order Date",
               "ship_date": "Ship Date", "ship_mode": "Ship Mode", "customer_id": "Customer ID",
               "customer_name": "Customer Name", "segment": "Segment", "region": "Region",
               "state": "State", "product_id": "Product ID", "product_name": "Product Name",
               "category": "Category", "sub_category": "Sub-Category", "sales": "Sales",
               "quantity": "Quantity", "discount": "Discount", "profit": "Profit"}
    out_cols = []
    for c in fact.columns:
        col = F.col(c)
        if c in ("order_date", "ship_date"):
            col = F.date_format(col, "M/d/yyyy")
        elif c in ("order_id", "customer_id", "product_id"):
            col = F.concat(F.lit("ID-"), col.cast("string"))
        out_cols.append(col.cast("string").alias(headers[c]))
    (fact.select(*out_cols).coalesce(1).write.option("header", True)
     .option("quote", '"').option("escape", '"').csv(f"{src}/lines"))
    out = tempfile.mkdtemp(prefix="csvout-", dir="/tmp")
    status, _ = run_pipeline(spark, f"{src}/lines", out, kind="csv",
                             stages=["analysis", "dashboards"])
    assert all(r["ok"] for r in status.collect())
    got = {r["category"]: (r["sales"], r["profit"], r["order_count"])
           for r in spark.read.parquet(f"{out}/category_performance").collect()}
    want = {r["category"]: (r["sales"], r["profit"], r["order_count"])
            for r in registry.QUERIES["category_performance"](spark, SF_SMALL).collect()}
    assert got == want
    got_dow = {r["day_of_week"]: r["sales"]
               for r in spark.read.parquet(f"{out}/day_of_week_metrics").collect()}
    want_dow = {r["day_of_week"]: r["sales"]
                for r in registry.QUERIES["dash_day_of_week"](spark, SF_SMALL).collect()}
    assert got_dow == want_dow


def test_one_call_forecast_and_source_detection(spark):
    from kpiforge.operators import ml, series
    from kpiforge.sources import read_sales
    assert read_sales(spark, SF_SMALL).columns[:2] == ["row_id", "order_id"]
    f = ml.materialize(series.monthly_features(prepared_fact(
        spark, SF_SMALL, ["order_date", "sales", "profit", "quantity", "discount", "order_id"],
        extra_parts=True)), single=True)
    summary, fc = ml.forecast_series(f, horizon=3, models=["linear_regression"])
    assert fc.count() == 3 and summary.where("selected").count() == 1


def test_sales_model_is_deterministic(spark):
    from kpiforge.operators import ml
    p = prepared_fact(spark, SF_SMALL)
    a = ml.fit_sales_model(p, num_trees=10, max_depth=4)
    b = ml.fit_sales_model(p, num_trees=10, max_depth=4)
    assert a.importance.collect() == b.importance.collect()
    assert a.metrics.collect() == b.metrics.collect()


def test_many_series_fit_without_driver_loops(spark):
    """80 series x 30 months: every fit is a task, the driver only plans."""
    from pyspark.sql import Row
    from kpiforge.operators import ml, series
    rows = [Row(category=f"c{k:03d}", order_date=dt.date(2000 + m // 12, m % 12 + 1, 1),
                sales=100.0 + k + m, profit=10.0, quantity=1.0, discount=0.0, order_id=m)
            for k in range(80) for m in range(30)]
    df = spark.createDataFrame(rows).withColumn("sales", F.col("sales").cast("decimal(18,4)")) \
        .withColumn("profit", F.col("profit").cast("decimal(18,4)"))
    f = ml.materialize(series.category_features(df))
    summary, fc = ml.forecast_series(f, horizon=3, keys=["category"])
    assert summary.where("selected").count() == 80
    assert fc.count() == 240


def test_bench_prints_one_json_line():
    import json
    import subprocess
    import sys as _sys
    env = dict(os.environ, BENCH_SF_DIR=SF_SMALL, BENCH_CPUS="2")
    out = subprocess.run([_sys.executable, "bench.py", "category_performance", "monthly_sales"],
                         cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                         env=env, capture_output=True, text=True, timeout=600)
    lines = [x for x in out.stdout.splitlines() if x.strip()]
    assert len(lines) == 1, out.stdout
    d = json.loads(lines[0])
    assert d["unit"] == "sec" and set(d["queries"]) == {"category_performance", "monthly_sales"}
    assert d["sf"] == 0.001 and "failed" not in d


def _flat(spark, folder, bad_date=False):
    """The small tables as one flat Parquet table with text dates."""
    lines = raw_fact(spark, SF_SMALL)
    for c in ("order_date", "ship_date"):
        lines = lines.withColumn(c, F.date_format(c, "M/d/yyyy"))
    if bad_date:
        first = lines.agg(F.min("row_id")).first()[0]
        lines = lines.withColumn("order_date", F.when(F.col("row_id") == first, "13/45/2016")
                                 .otherwise(F.col("order_date")))
    lines.write.parquet(folder)
    return folder


def test_run_forecast_survives_one_bad_date(spark, tmp_path):
    src = _flat(spark, str(tmp_path / "flat"), bad_date=True)
    status, _ = run_forecast(spark, src, str(tmp_path / "out"), kind="parquet",
                             candidates=["linear_regression"])
    ok = {r["stage"]: r["ok"] for r in status.collect() if r["key"] is None}
    assert ok == {"forecast": True, "category_forecast": True}
    assert spark.read.parquet(str(tmp_path / "out" / "_status")).count() == status.count()


def test_run_analysis_isolates_one_bad_date(spark, tmp_path):
    src = _flat(spark, str(tmp_path / "flat"), bad_date=True)
    status, cat = run_analysis(spark, src, str(tmp_path / "out"), kind="parquet",
                               sales_model_options={"max_depth": 3, "num_trees": 2, "max_bins": 32})
    assert [r["ok"] for r in status.collect()] == [False, False]
    assert cat.count() == 0 and spark.read.parquet(str(tmp_path / "out" / "_status")).count() == 2


def test_run_analysis_with_the_sales_model(spark, tmp_path):
    status, cat = run_analysis(spark, SF_SMALL, str(tmp_path / "out"),
                               sales_model_options={"max_depth": 3, "num_trees": 3, "max_bins": 32})
    assert all(r["ok"] for r in status.collect())
    names = {r["name"] for r in cat.collect()}
    assert {"sales_model_metrics", "feature_importance"} < names


def test_sales_model_ignores_layout_and_beats_the_mean(spark):
    """The same rows in 4 and 8 partitions give the same model; on a planted
    signal it predicts better than the mean."""
    rows = [(f"r{i}", ("a", "b", "c")[i % 3], float(i % 7), 100.0 * (i % 3) + (i % 7)) for i in range(600)]
    df = spark.createDataFrame(rows, "row_id string, category string, quantity double, sales double")
    fit = lambda d: ml.fit_sales_model(d, num_trees=5, max_depth=4, max_bins=32,
                                       partitions=6).metrics.first()
    a, b = fit(df.repartition(4)), fit(df.repartition(8))
    assert a == b and a["r2"] > 0.9


def test_free_text_is_not_one_hot_encoded(spark):
    rows = [(f"r{i}", ("a", "b")[i % 2], f"note {i}", float(i % 5), float(i % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id string, category string, note string, quantity double, sales double")
    m = ml.fit_sales_model(df, num_trees=2, max_depth=2, max_bins=32, partitions=2)
    assert m.categorical == ["category"]


def test_short_series_raises(spark):
    f = spark.createDataFrame([(dt.date(2020, m, 1), float(m)) for m in range(1, 6)], "date date, sales double")
    with pytest.raises(Exception, match="cannot make 5 time-series folds"):
        series.ts_folds(f).collect()
    with pytest.raises(Exception, match="cannot make 5 time-series folds"):
        leastsq.linear_models(f.withColumn("x", F.lit(1.0))).collect()


def _planted(spark, n=48):
    """A series that follows its feature x exactly, y is noise, z is never observed."""
    rows = [(dt.date(2015 + k // 12, k % 12 + 1, 1), float(k), float(k * 37 % 11), None, 3.0 * k + 5)
            for k in range(n)]
    f = spark.createDataFrame(rows, "date date, x double, y double, z double, sales double")
    ahead = spark.createDataFrame([(1, dt.date(2020, 1, 1), 48.0, 1.0), (2, dt.date(2020, 2, 1), None, 1.0)],
                                  "step bigint, date date, x double, y double")
    return f, ahead


def test_series_fits_follow_a_planted_signal(spark):
    f, ahead = _planted(spark)
    fits = ml.materialize(forecast.series_fits(f, ahead, ["linear_regression", "random_forest"]))
    scores = {r["model"]: r for r in ml.cv_summary(fits).collect()}
    assert scores["linear_regression"]["selected"]
    assert scores["linear_regression"]["mean_rmse"] < 1e-3
    # a tree cannot extrapolate a trend, but is closer than the mean of its past
    t = 8
    naive = sum((sum((3.0 * (s + j) + 5 - (3.0 * (s - 1) / 2 + 5)) ** 2 for j in range(t)) / t) ** 0.5
                for s in range(8, 48, t)) / 5
    assert scores["random_forest"]["mean_rmse"] < naive
    # the step that lacks an input has no prediction
    told = ml.selected_forecast(fits).collect()
    assert [r["step"] for r in told] == [1] and abs(told[0]["forecasted_sales"] - 149.0) < 1e-3
    folds = fits.where("fold >= 0 and model = 'random_forest'").orderBy("fold").collect()
    assert [(r["train_size"], r["test_size"]) for r in folds] == [(8, 8), (16, 8), (24, 8), (32, 8), (40, 8)]
    weights = {r["feature"]: r["importance"] for r in fits.where("feature is not null").collect()}
    assert set(weights) == {"x", "y"} and weights["x"] > weights["y"]


def test_series_fits_short_series_and_failing_model(spark, monkeypatch):
    f, ahead = _planted(spark, 5)
    with pytest.raises(ValueError, match="cannot make 5 time-series folds"):
        forecast.series_fits(f, ahead, ["linear_regression"])

    def broken(bins):
        raise RuntimeError("no such learner")
    monkeypatch.setitem(forecast.ENSEMBLES, "broken", broken)
    f, ahead = _planted(spark, 12)
    fits = ml.materialize(forecast.series_fits(f, ahead, ["broken", "linear_regression"]))
    errors = fits.where("error is not null").collect()
    assert {r["model"] for r in errors} == {"broken"} and len(errors) == 6
    assert {r["model"] for r in ml.selected_forecast(fits).collect()} == {"linear_regression"}


def test_predictors_choose_the_first_on_a_tie(spark):
    f, ahead = _planted(spark)
    told = {"b": "x", "a": "x"}
    fits = forecast.predictor_fits(f, ahead, told)
    assert [r["model"] for r in ml.cv_summary(fits, (), ("b", "a")).where("selected").collect()] == ["b"]
    done = ml.selected_forecast(fits, (), ("b", "a")).collect()
    assert [(r["step"], r["forecasted_sales"]) for r in done] == [(1, 48.0)]


def test_a_poisoned_series_fails_alone(spark):
    months = [dt.date(2018 + k // 12, k % 12 + 1, 1) for k in range(24)]
    rows = [(c, d, float(i) if c == "good" or i != 20 else float("inf"), float(i))
            for c in ("good", "poisoned") for i, d in enumerate(months)]
    f = spark.createDataFrame(rows, "category string, date date, x double, sales double")
    future = spark.createDataFrame([(c, 1, dt.date(2020, 1, 1), 24.0) for c in ("good", "poisoned")],
                                   "category string, step bigint, date date, x double")
    fits = forecast.linear_fits(f, future, ["category"])
    failed = {r["category"] for r in fits.where("error is not null").collect()}
    assert failed == {"poisoned"}
    done = ml.selected_forecast(fits, ["category"]).collect()
    assert "good" in {r["category"] for r in done}


def test_gaps_in_floating_input_are_null(spark, tmp_path):
    src = str(tmp_path / "flat")
    spark.createDataFrame([("a", float("nan")), ("b", float("inf")), ("c", 2.0), ("d", None)],
                          "row_id string, quantity double").write.parquet(src)
    got = {r["row_id"]: r["quantity"] for r in read_sales(spark, src).collect()}
    assert got == {"a": None, "b": None, "c": 2.0, "d": None}
    assert {r["quantity"] for r in clean.impute(read_sales(spark, src)).collect()} == {2.0}
