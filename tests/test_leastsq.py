"""Least squares from product sums against NumPy on the rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from kpiforge.operators import forecast, leastsq, ml, series


def _frame(spark, blocks, names):
    """{key: (X, y)} -> rows (category, date, features, sales)."""
    rows = [(k, dt.date(2000 + i // 12, i % 12 + 1, 1), *map(float, x), float(v))
            for k, (X, y) in blocks.items() for i, (x, v) in enumerate(zip(X, y))]
    cols = ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame(rows, f"category string, date date, {cols}, sales double")


def _numpy(X, y):
    w, *_ = np.linalg.lstsq(X - X.mean(0), y - y.mean(), rcond=None)
    return w, y.mean() - X.mean(0) @ w


@pytest.mark.parametrize("n,p", [(40, 3), (36, 12), (48, 20)])
def test_every_fold_equals_the_shortest_least_squares(spark, n, p):
    """Also in folds with fewer rows than features."""
    rng = np.random.default_rng(n * p)
    scale = 10.0 ** rng.integers(-2, 4, p)
    blocks = {k: (rng.normal(size=(n, p)) * scale, rng.normal(size=n) * 1e5 + 3e5) for k in "ab"}
    names = [f"x{i}" for i in range(p)]
    df = _frame(spark, blocks, names)
    rows = leastsq.linear_models(df, ["category"]).collect()
    assert len(rows) == 12
    t = n // 6
    for r in rows:
        X, y = blocks[r["category"]]
        size = n if r["fold"] < 0 else n - (5 - r["fold"]) * t
        assert r["train_size"] == size
        w, c = _numpy(X[:size], y[:size])
        # the error grows with how far the features are apart in size
        assert np.allclose(X @ r["coefficients"] + r["intercept"], X @ w + c, rtol=1e-4, atol=20)
        assert np.linalg.norm(r["coefficients"]) <= np.linalg.norm(w) * (1 + 1e-4)


def test_dependent_constant_and_absent_columns(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 2))
    X = np.c_[x, x.sum(axis=1) / 2, np.full(30, 7.0)]
    y = 4 * x[:, 0] - x[:, 1] + 2
    df = _frame(spark, {"a": (X, y)}, ["u", "v", "mean", "same"]).withColumn("never", F.lit(None).cast("double"))
    got = {r["term"]: r["coefficient"] for r in leastsq.coefficient_rows(
        leastsq.linear_models(df, ["category"]).where("fold = -1"), df, ["category"]).collect()}
    w, c = _numpy(X, y)
    assert set(got) == {"intercept", "u", "v", "mean", "same"} and got["same"] == 0
    assert [got[k] for k in ("u", "v", "mean", "intercept")] == pytest.approx([*w[:3], c], abs=1e-6)


def test_many_series_in_one_plan_without_python(spark):
    """No Python, no collected rows, and rows are shuffled once, by series."""
    rng = np.random.default_rng(5)
    blocks = {f"k{i:03d}": (rng.normal(size=(24, 2)), rng.normal(size=24)) for i in range(50)}
    df = _frame(spark, blocks, ["u", "v"])
    models = leastsq.linear_models(df, ["category"], min_train=5, min_test=2)
    assert models.count() == 50 * 5          # the first fold has 4 rows
    plan = models._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning") == 1


def test_ensembles_of_a_small_panel(spark):
    rng = np.random.default_rng(6)
    blocks = {k: (x := rng.normal(size=(18, 1)), 100 * x[:, 0]) for k in "ab"}
    blocks["short"] = blocks["a"][0][:4], blocks["a"][1][:4]
    df = _frame(spark, blocks, ["x"])
    ahead = spark.createDataFrame([(k, 1, dt.date(2030, 1, 1), 0.5) for k in blocks],
                                  "category string, step bigint, date date, x double")
    fits = ml.materialize(forecast.panel_fits(df, ahead, "category", ["random_forest"], min_train=5, min_test=2))
    s = ml.cv_summary(fits, ["category"]).collect()
    assert {r["category"]: r["folds_scored"] for r in s} == {"a": 4, "b": 4}
    told = {r["category"]: r["forecasted_sales"] for r in ml.selected_forecast(fits, ["category"]).collect()}
    assert set(told) == {"a", "b"} and all(abs(v - 50) < 60 for v in told.values())
    with pytest.raises(ValueError, match="more than 2 series"):
        forecast.panel_fits(df, ahead, "category", most_series=2)


def _months(spark, seed, n, size):
    """Features of a made-up series whose lags are nearly copies of each other."""
    rng = np.random.default_rng(seed)
    days = np.array([31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.arange(n) % 12]
    sales, profit, quantity = (np.round(days * size * k * (1 + 1e-3 * rng.standard_normal(n)), 2)
                               for k in (1.2e7, 1.1e6, 6e3))
    rows = [(2000 + i // 12, i % 12 + 1, dt.date(2000 + i // 12, i % 12 + 1, 1), *map(float, v))
            for i, v in enumerate(zip(sales, profit, quantity, 0.05 + 1e-5 * rng.standard_normal(n)))]
    m = spark.createDataFrame(rows, "year bigint, month bigint, date date, sales double, profit double, "
                                    "quantity double, avg_discount double")
    m = m.withColumn("order_count", F.lit(1)).withColumn("_sales_dec", F.col("sales").cast("decimal(28,4)"))
    m = series.add_rolling(series.add_lags(m, series.GLOBAL_LAGS, series.GLOBAL_LAG_MEASURES),
                           series.GLOBAL_WINDOWS, True)
    return series.add_cyclical(m).where("date >= '2001-01-01'")


@pytest.mark.parametrize("seed", [0, 1, 2, 3])
def test_pivots_lost_to_rounding_leave_a_least_squares_solution(spark, seed):
    """More features than rows, each nearly a sum of others: every fold is still
    fitted as closely as its rows allow, and none divides by zero."""
    f = ml.materialize(_months(spark, seed, 30, 360), single=True)
    names = series.feature_columns(f)
    rows = f.orderBy("date").collect()
    X = np.array([[r[c] for c in names] for r in rows], float)
    y = np.array([r["sales"] for r in rows])
    models = leastsq.linear_models(f).collect()
    assert len(models) == 6
    for r in models:
        n = r["train_size"]
        told = X[:n] @ np.array(r["coefficients"]) + r["intercept"]
        assert np.sqrt(np.mean((told - y[:n]) ** 2)) < 1e-4 * y[:n].std()
