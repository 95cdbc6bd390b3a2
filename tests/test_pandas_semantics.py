"""The same reports computed with plain pandas on sf0.001 (brute force, the
way a single-machine script would), compared with the Spark results.

This checks the semantics themselves (pct_change, shift/rolling, nunique,
two-level means, expanding folds), independently of the SQL oracles.
"""

import numpy as np
import pandas as pd
import pytest

from kpiforge.plans import registry
from kpiforge.plans.frames import prepared_fact, raw_fact

from sf_paths import SF_SMALL

Q = registry.QUERIES


@pytest.fixture(scope="module")
def raw(spark):
    df = raw_fact(spark, SF_SMALL).toPandas()
    for c in ("sales", "profit"):
        df[c] = df[c].astype(float)
    df["order_date"] = pd.to_datetime(df["order_date"])
    return df


@pytest.fixture(scope="module")
def prepared(spark):
    df = prepared_fact(spark, SF_SMALL, extra_parts=True).toPandas()
    for c in ("sales", "profit"):
        df[c] = df[c].astype(float)
    df["order_date"] = pd.to_datetime(df["order_date"])
    return df


def by(df, key):
    return df.set_index(key).sort_index()


def test_category_performance(spark, prepared):
    g = prepared.groupby("category").agg(sales=("sales", "sum"), profit=("profit", "sum"),
                                         quantity=("quantity", "sum"),
                                         order_count=("order_id", pd.Series.nunique))
    g["profit_margin"] = g["profit"] / g["sales"] * 100
    got = by(Q["category_performance"](spark, SF_SMALL).toPandas(), "category")
    for c in g.columns:
        assert np.allclose(got[c].astype(float), g[c].astype(float), rtol=1e-10), c


def test_segment_customers_and_aov(spark, raw, prepared):
    g = prepared.groupby("segment").agg(sales=("sales", "sum"),
                                        customer_count=("customer_id", pd.Series.nunique))
    g["sales_per_customer"] = g["sales"] / g["customer_count"]
    got = by(Q["segment_performance"](spark, SF_SMALL).toPandas(), "segment")
    assert (got["customer_count"] == g["customer_count"]).all()
    assert np.allclose(got["sales_per_customer"], g["sales_per_customer"], rtol=1e-10)
    aov = raw.groupby(["segment", "order_id"])["sales"].sum().groupby("segment").mean()
    got = by(Q["dash_segment_aov"](spark, SF_SMALL).toPandas(), "segment")
    assert np.allclose(got["average_order_value"], aov, rtol=1e-10)


def test_monthly_growth_is_pct_change(spark, prepared):
    m = prepared.groupby(prepared["order_date"].dt.to_period("M")).agg(
        sales=("sales", "sum"), profit=("profit", "sum"), order_count=("order_id", "count"))
    m.index = m.index.astype(str)
    m["sales_growth_rate"] = m["sales"].pct_change() * 100
    got = by(Q["monthly_growth"](spark, SF_SMALL).toPandas(), "month")
    assert list(got.index) == list(m.index)
    assert (got["order_count"] == m["order_count"]).all()
    a, b = got["sales_growth_rate"].astype(float), m["sales_growth_rate"]
    assert np.allclose(a[1:], b[1:], rtol=1e-9) and pd.isna(a.iloc[0])


def _monthly(prepared):
    m = prepared.groupby([prepared["order_date"].dt.year.rename("year"),
                          prepared["order_date"].dt.month.rename("month")]).agg(
        sales=("sales", "sum"), profit=("profit", "sum"), quantity=("quantity", "sum"),
        avg_discount=("discount", "mean"), order_count=("order_id", "count")).reset_index()
    return m.sort_values(["year", "month"]).reset_index(drop=True)


def test_monthly_features_are_shift_and_rolling(spark, prepared):
    m = _monthly(prepared)
    for lag in (1, 2, 3, 6, 12):
        if len(m) > lag:
            for c in ("sales", "profit", "quantity"):
                m[f"{c}_lag_{lag}"] = m[c].shift(lag)
    for w in (3, 6, 12):
        if len(m) > w:
            m[f"sales_rolling_mean_{w}"] = m["sales"].rolling(window=w).mean().shift(1)
            m[f"sales_rolling_std_{w}"] = m["sales"].rolling(window=w).std().shift(1)
    m["month_sin"] = np.sin(2 * np.pi * m["month"] / 12)
    m["month_cos"] = np.cos(2 * np.pi * m["month"] / 12)
    m = m.dropna().reset_index(drop=True)
    got = Q["monthly_features"](spark, SF_SMALL).toPandas().sort_values("date") \
        .reset_index(drop=True)
    assert len(got) == len(m)
    for c in m.columns:
        tol = 0.01 if "_std_" in c else 1e-9
        assert np.allclose(got[c].astype(float), m[c].astype(float), rtol=1e-9, atol=tol), c


def test_category_panel_matches_per_category_loop(spark, prepared):
    out = []
    for cat, part in prepared.groupby("category"):
        m = _monthly(part)
        for lag in (1, 2, 3):
            if len(m) > lag:
                m[f"sales_lag_{lag}"] = m["sales"].shift(lag)
        for w in (3, 6):
            if len(m) > w:
                m[f"sales_rolling_mean_{w}"] = m["sales"].rolling(window=w).mean().shift(1)
        m = m.dropna()
        m["category"] = cat
        out.append(m)
    want = pd.concat(out).sort_values(["category", "year", "month"]).reset_index(drop=True)
    got = Q["category_features"](spark, SF_SMALL).toPandas().sort_values(
        ["category", "year", "month"]).reset_index(drop=True)
    assert len(got) == len(want)
    for c in ("sales_lag_1", "sales_lag_3", "sales_rolling_mean_6"):
        assert np.allclose(got[c], want[c], rtol=1e-9), c


def test_folds_are_expanding_window_splits(spark):
    f = Q["monthly_features"](spark, SF_SMALL).toPandas().sort_values("date") \
        .reset_index(drop=True)
    n = len(f)
    t = n // 6
    folds = Q["ts_folds"](spark, SF_SMALL).toPandas()
    for k in range(5):
        start = n - (5 - k) * t
        tr = set(folds[(folds.fold == k) & (folds.role == "train")]["date"])
        te = set(folds[(folds.fold == k) & (folds.role == "test")]["date"])
        assert tr == set(f["date"][:start]) and te == set(f["date"][start:start + t])


def test_future_rows_carry_the_last_values(spark, prepared):
    f = Q["monthly_features"](spark, SF_SMALL).toPandas().sort_values("date") \
        .reset_index(drop=True)
    fut = Q["future_features"](spark, SF_SMALL).toPandas().sort_values("step")
    last = f.iloc[-1]
    assert (fut["sales_lag_1"] == last["sales"]).all()
    assert (fut["sales_lag_6"] == f.iloc[-6]["sales"]).all()
    assert np.allclose(fut["sales_rolling_mean_3"], f["sales"].tail(3).mean(), rtol=1e-9)
    assert np.allclose(fut["avg_discount"], f["avg_discount"].mean(), rtol=1e-12)
    step = pd.to_datetime(last["date"]) + pd.to_timedelta(30 * fut["step"], unit="D")
    assert list(pd.to_datetime(fut["date"])) == list(step)


def test_iqr_bounds_are_pandas_quartiles(spark, raw):
    got = by(Q["iqr_bounds"](spark, SF_SMALL).toPandas(), "column")
    for c in ("sales", "profit", "quantity", "discount"):
        q1, q3 = raw[c].quantile(0.25), raw[c].quantile(0.75)
        assert got.loc[c, "q1"] == pytest.approx(q1, rel=1e-12)
        assert got.loc[c, "upper_bound"] == pytest.approx(q3 + 1.5 * (q3 - q1), rel=1e-12)


def test_calendar_dashboards_order_and_values(spark, raw):
    days = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
    d = raw.assign(day=raw["order_date"].dt.day_name()).groupby("day").agg(
        sales=("sales", "sum"), order_count=("order_id", pd.Series.nunique))
    got = Q["dash_day_of_week"](spark, SF_SMALL).toPandas()
    assert list(got["day_of_week"]) == [x for x in days if x in d.index]
    got = got.set_index("day_of_week")
    assert np.allclose(got["sales"], d.loc[got.index, "sales"], rtol=1e-10)
    assert (got["order_count"] == d.loc[got.index, "order_count"]).all()
    months = Q["dash_month_of_year"](spark, SF_SMALL).toPandas()
    assert list(months["month_of_year_ordinal"]) == sorted(months["month_of_year_ordinal"])


def test_hierarchy_weighted_profit(spark, prepared):
    got = Q["category_hierarchy"](spark, SF_SMALL).toPandas()
    leaf = prepared.groupby(["category", "sub_category"]).apply(
        lambda g: pd.Series({"sales": g["sales"].sum(),
                             "wp": (g["profit"] * g["sales"]).sum() / g["sales"].sum()}),
        include_groups=False)
    top = prepared.groupby("category").apply(
        lambda g: (g["profit"] * g["sales"]).sum() / g["sales"].sum(), include_groups=False)
    sub = got[got.level == "sub_category"].set_index(["category", "sub_category"]).sort_index()
    assert np.allclose(sub["weighted_profit"], leaf.loc[sub.index, "wp"], rtol=1e-9)
    cat = got[got.level == "category"].set_index("category").sort_index()
    assert np.allclose(cat["weighted_profit"], top.loc[cat.index], rtol=1e-9)


def test_top_subcategories_and_shares(spark, raw):
    s = raw.groupby("sub_category")["sales"].sum().sort_values(ascending=False).head(10)
    got = Q["dash_top_subcategory_sales"](spark, SF_SMALL).toPandas()
    assert list(got["sub_category"]) == list(s.index)
    share = Q["dash_category_share"](spark, SF_SMALL).toPandas().set_index("category")
    tot = raw.groupby("category")["sales"].sum()
    assert np.allclose(share["share_pct"], (tot / tot.sum() * 100).loc[share.index], rtol=1e-10)
