"""Monthly series, lag/rolling/cyclical features, CV folds and horizon rows.

Scale: the expensive step is the monthly aggregate over order lines (partial
+ final hash aggregate keyed by (keys, year, month)). Every window afterwards
runs on that aggregate - one row per key and month - so a window without a
partition key (the single global series) holds a few hundred rows at most,
and a keyed panel is partitioned by its key. Order lines are never windowed.

Lags and rolling statistics are row based, like pandas ``shift``/``rolling``:
a month with no sales is absent, and a lag crosses the gap. A lag/rolling
column "exists" for a series only when the series is longer than the lag or
window (the reference adds the column only then); here the column is null for
such series and is ignored by the row filter that drops incomplete rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import cyclical_month
from ..functions.measures import MONEY
from ..spec import DEFAULT_SPEC, SalesSpec

GLOBAL_LAGS = (1, 2, 3, 6, 12)
GLOBAL_LAG_MEASURES = ("sales", "profit", "quantity")
GLOBAL_WINDOWS = (3, 6, 12)
CATEGORY_LAGS = (1, 2, 3)
CATEGORY_LAG_MEASURES = ("sales", "profit")
CATEGORY_WINDOWS = (3, 6)
N_SPLITS = 5
# Columns that are never model features of the monthly series.
NON_FEATURES = ("year", "month", "date", "sales", "profit", "quantity", "order_count",
                "_sales_dec", "_n")


def _w(keys: Sequence[str]) -> Window:
    return (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("date")


def monthly_series(df: DataFrame, keys: Sequence[str] = (),
                   spec: SalesSpec = DEFAULT_SPEC) -> DataFrame:
    """(keys, year, month) -> sales, profit, quantity, avg_discount, order_count,
    with ``date`` = first day of the month. Null keys/dates are dropped."""
    d = F.col(spec.order_date)
    keyed = df.where(d.isNotNull())
    for k in keys:
        keyed = keyed.where(F.col(k).isNotNull())
    g = (keyed.groupBy(*keys, F.year(d).cast("bigint").alias("year"),
                       F.month(d).cast("bigint").alias("month"))
         .agg(F.coalesce(F.sum(F.col(spec.sales).cast(MONEY)), F.lit(0).cast(MONEY))
              .alias("_sales_dec"),
              F.coalesce(F.sum(F.col(spec.profit).cast(MONEY)), F.lit(0).cast(MONEY))
              .cast("double").alias("profit"),
              F.coalesce(F.sum(F.col(spec.quantity).cast(MONEY)), F.lit(0).cast(MONEY))
              .cast("double").alias("quantity"),
              F.try_divide(F.sum(F.col(spec.discount).cast(MONEY)).cast("double"),
                           F.count(spec.discount).cast("double")).alias("avg_discount"),
              F.count(spec.order_id).cast("bigint").alias("order_count")))
    return g.select(*keys, "year", "month",
                    F.make_date("year", "month", F.lit(1)).alias("date"),
                    F.col("_sales_dec").cast("double").alias("sales"),
                    "profit", "quantity", "avg_discount", "order_count", "_sales_dec")


def add_lags(m: DataFrame, lags: Sequence[int], measures: Sequence[str],
             keys: Sequence[str] = ()) -> DataFrame:
    """``{measure}_lag_{k}``: value k rows earlier in the series (null where the
    series has k rows or fewer, i.e. where the reference has no such column)."""
    w = _w(keys)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys)) if keys else \
        F.count(F.lit(1)).over(Window.partitionBy())
    out = m.withColumn("_n", n)
    cols = []
    for k in lags:
        for c in measures:
            cols.append(F.when(F.col("_n") > k, F.lag(c, k).over(w)).alias(f"{c}_lag_{k}"))
    return out.select("*", *cols)


def add_rolling(m: DataFrame, windows: Sequence[int], with_std: bool,
                keys: Sequence[str] = ()) -> DataFrame:
    """Trailing mean (and sample std) of sales over the ``w`` previous rows,
    excluding the current one; null until ``w`` rows exist. The mean is an
    exact decimal sum / w."""
    base = _w(keys)
    if "_n" not in m.columns:
        m = m.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    cols = []
    for win in windows:
        fr = base.rowsBetween(-win, -1)
        full = (F.count("sales").over(fr) == win) & (F.col("_n") > win)
        cols.append(F.when(full, F.sum("_sales_dec").over(fr).cast("double") / F.lit(float(win)))
                    .alias(f"sales_rolling_mean_{win}"))
        if with_std:
            cols.append(F.when(full, F.stddev_samp("sales").over(fr))
                        .alias(f"sales_rolling_std_{win}"))
    return m.select("*", *cols)


def add_cyclical(m: DataFrame) -> DataFrame:
    s, c = cyclical_month("month")
    return m.select("*", s.alias("month_sin"), c.alias("month_cos"))


def _lag_names(lags, measures):
    return [f"{c}_lag_{k}" for k in lags for c in measures]


def drop_incomplete(m: DataFrame, lag_cols: Sequence[tuple[str, int]]) -> DataFrame:
    """Drop rows with a null value, treating a lag/rolling column as absent
    for a series too short to have it (``(column, needed_length)`` pairs)."""
    cond = None
    for c in m.columns:
        if c.startswith("_"):
            continue
        need = dict(lag_cols).get(c)
        ok = F.col(c).isNotNull()
        if need is not None:
            ok = ok | (F.col("_n") <= F.lit(need))
        cond = ok if cond is None else cond & ok
    return m.where(cond)


def monthly_features(df: DataFrame, spec: SalesSpec = DEFAULT_SPEC,
                     lags: Sequence[int] = GLOBAL_LAGS,
                     windows: Sequence[int] = GLOBAL_WINDOWS) -> DataFrame:
    """Global monthly feature table (the forecaster's training rows)."""
    m = monthly_series(df, (), spec)
    m = add_lags(m, lags, GLOBAL_LAG_MEASURES)
    m = add_rolling(m, windows, True)
    m = add_cyclical(m)
    need = [(n, k) for k in lags for n in _lag_names([k], GLOBAL_LAG_MEASURES)]
    need += [(f"sales_rolling_{s}_{w}", w) for w in windows for s in ("mean", "std")]
    return drop_incomplete(m, need)


def category_features(df: DataFrame, spec: SalesSpec = DEFAULT_SPEC,
                      lags: Sequence[int] = CATEGORY_LAGS,
                      windows: Sequence[int] = CATEGORY_WINDOWS) -> DataFrame:
    """Per-category feature panel: one DataFrame, windows partitioned by key."""
    keys = [spec.category]
    m = monthly_series(df, keys, spec)
    m = add_lags(m, lags, CATEGORY_LAG_MEASURES, keys)
    m = add_rolling(m, windows, False, keys)
    m = add_cyclical(m)
    need = [(n, k) for k in lags for n in _lag_names([k], CATEGORY_LAG_MEASURES)]
    need += [(f"sales_rolling_mean_{w}", w) for w in windows]
    return drop_incomplete(m, need)


def feature_columns(features: DataFrame, keys: Sequence[str] = ()) -> list[str]:
    """Model inputs of a feature table: everything except keys, targets,
    calendar columns and helpers."""
    return [c for c in features.columns
            if c not in NON_FEATURES and c not in keys and not c.startswith("_")]


def public(features: DataFrame) -> DataFrame:
    """Drop helper columns (``_``-prefixed)."""
    return features.select(*[c for c in features.columns if not c.startswith("_")])


# --------------------------------------------------------------------------
# Time-series cross-validation folds (expanding window, TimeSeriesSplit)
# --------------------------------------------------------------------------

def fold_size(n: Column, n_splits: int, keys: Sequence[str]) -> Column:
    """Rows per test fold. A single series too short for its folds is an error;
    in a keyed panel such a series has no folds (it gets no model)."""
    t = F.floor(n / F.lit(n_splits + 1))
    if keys:
        return t
    return F.when(t >= 1, t).otherwise(F.raise_error(F.concat(
        n.cast("string"), F.lit(f" rows cannot make {n_splits} time-series folds"))).cast("bigint"))


def ts_folds(features: DataFrame, keys: Sequence[str] = (), n_splits: int = N_SPLITS,
             min_train: int = 0, min_test: int = 0) -> DataFrame:
    """Row -> fold assignment for ``n_splits`` expanding folds per series.

    With n rows and t = n // (n_splits + 1), fold k tests rows
    [n - (n_splits - k) * t, + t) and trains on every row before. Output: keys,
    date, fold, role ('train'/'test'), train_size, test_size. Folds below
    ``min_train``/``min_test`` are dropped (the per-category rule). A single
    series with fewer than n_splits + 1 rows raises, one of a panel has no folds.
    """
    w = _w(keys)
    whole = Window.partitionBy(*keys)
    r = features.select(*keys, "date",
                        (F.row_number().over(w) - 1).alias("_rn"),
                        F.count(F.lit(1)).over(whole).alias("_n"))
    t = fold_size(F.col("_n"), n_splits, keys)
    r = r.withColumn("_t", t).where(F.col("_t") >= 1)
    r = r.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    start = F.col("_n") - (F.lit(n_splits) - F.col("fold")) * F.col("_t")
    role = (F.when(F.col("_rn") < start, F.lit("train"))
            .when(F.col("_rn") < start + F.col("_t"), F.lit("test")))
    out = (r.select(*keys, "date", F.col("fold").cast("bigint").alias("fold"),
                    role.alias("role"), start.cast("bigint").alias("train_size"),
                    F.col("_t").cast("bigint").alias("test_size"))
           .where(F.col("role").isNotNull()))
    return out.where((F.col("train_size") >= min_train) & (F.col("test_size") >= min_test))


# --------------------------------------------------------------------------
# Horizon rows (the rows a fitted model scores)
# --------------------------------------------------------------------------

def future_dates(last: Column, horizon: int, step: str = "30d") -> Column:
    """Array of the horizon dates after ``last``: ``30d`` adds 30*i days (the
    reference's rule, which can repeat or skip a calendar month), ``month``
    adds i calendar months."""
    i = F.sequence(F.lit(1), F.lit(horizon))
    if step == "30d":
        return F.transform(i, lambda x: F.date_add(last, x * 30))
    if step == "month":
        return F.transform(i, lambda x: F.add_months(last, x))
    raise ValueError(f"unknown step {step!r}")


def future_features(features: DataFrame, horizon: int, keys: Sequence[str] = (),
                    lags: Sequence[int] = GLOBAL_LAGS,
                    lag_measures: Sequence[str] = GLOBAL_LAG_MEASURES,
                    windows: Sequence[int] = GLOBAL_WINDOWS, with_std: bool = True,
                    require_full_window: bool = False, step: str = "30d") -> DataFrame:
    """Feature rows for ``horizon`` future steps per series.

    Non-recursive (the reference's rule): lag k is the value k rows from the
    end and stays constant over the horizon; rolling stats cover the last w
    rows including the final one; avg_discount is the series mean; only the
    month (hence month_sin/cos) changes. A lag beyond the series length is
    0.0; a rolling stat of a short series is null (global path) or 0.0
    (category path, ``require_full_window``).
    """
    w_desc = (Window.partitionBy(*keys) if keys else Window.partitionBy()) \
        .orderBy(F.col("date").desc())
    r = features.withColumn("_rd", F.row_number().over(w_desc))
    aggs = [F.max("date").alias("_last"), F.count(F.lit(1)).alias("_len"),
            F.avg("avg_discount").alias("avg_discount")]
    for k in lags:
        for c in lag_measures:
            aggs.append(F.coalesce(F.max(F.when(F.col("_rd") == k, F.col(c))), F.lit(0.0))
                        .alias(f"{c}_lag_{k}"))
    for win in windows:
        in_w = F.col("_rd") <= win
        mean = (F.sum(F.when(in_w, F.col("_sales_dec"))).cast("double") / F.lit(float(win)))
        full = F.count(F.when(in_w, F.lit(1))) == win
        default = F.lit(0.0) if require_full_window else F.lit(None).cast("double")
        aggs.append(F.when(full, mean).otherwise(default).alias(f"sales_rolling_mean_{win}"))
        if with_std:
            aggs.append(F.when(full, F.stddev_samp(F.when(in_w, F.col("sales"))))
                        .otherwise(default).alias(f"sales_rolling_std_{win}"))
    last = r.groupBy(*keys).agg(*aggs)
    steps = last.select("*", F.posexplode(future_dates(F.col("_last"), horizon, step))
                        .alias("_i", "date"))
    s, c = cyclical_month(F.month("date"))
    feats = [f"{c}_lag_{k}" for k in lags for c in lag_measures]
    feats += [f"sales_rolling_{st}_{win}" for win in windows
              for st in (("mean", "std") if with_std else ("mean",))]
    return steps.select(*keys, (F.col("_i") + 1).cast("bigint").alias("step"), "date",
                        F.year("date").cast("bigint").alias("year"),
                        F.month("date").cast("bigint").alias("month"),
                        "avg_discount", *feats, s.alias("month_sin"), c.alias("month_cos"))


def recursive_forecast(monthly: DataFrame, horizon: int, rules: dict[str, Sequence[float]],
                       keys: Sequence[str] = (), step: str = "30d") -> DataFrame:
    """(keys, model, step, date, forecasted_sales): every rule run forward, each
    step's value being the next step's last month.

    A rule is the weights of the last months, the latest first: ``[1.0]`` repeats
    the last month, ``[1/3] * 3`` is the trailing mean. A series needs as many
    months as its rule has weights. Only the months that the longest rule looks
    at are kept per series; the steps are a fold over them inside the row, so the
    horizon costs no shuffle and the number of series has no bound.
    """
    keys = list(keys)
    most = max(map(len, rules.values()))
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(F.col("date").desc())
    tail = (monthly.withColumn("_rd", F.row_number().over(w)).where(F.col("_rd") <= most)
            .groupBy(*keys).agg(F.max("date").alias("_last"), F.transform(
                F.array_sort(F.collect_list(F.struct("_rd", F.col("sales").cast("double").alias("v")))),
                lambda x: x["v"]).alias("_tail")))
    told = F.array(*[F.struct(F.lit(m).alias("model"), F.array(*[F.lit(float(x)) for x in weights]).alias("w"))
                     for m, weights in rules.items()])

    def ahead(state: Column, _: Column) -> Column:
        terms = F.zip_with(F.slice(state["tail"], 1, F.size("w")), "w", lambda x, c: x * c)
        value = F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)
        return F.struct(F.concat(F.array(value), state["tail"]).alias("tail"),
                        F.array_append(state["told"], value).alias("told"))

    start = F.struct(F.col("_tail").alias("tail"), F.array().cast("array<double>").alias("told"))
    run = (tail.select(*keys, "_last", "_tail", F.explode(told).alias("_r")).select("*", "_r.*")
           .where(F.size("_tail") >= F.size("w"))
           .withColumn("_told", F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, ahead)["told"]))
    steps = run.select(*keys, "model", F.posexplode(F.arrays_zip(
        future_dates(F.col("_last"), horizon, step).alias("date"), F.col("_told").alias("sales"))).alias("_i", "_s"))
    return steps.select(*keys, "model", (F.col("_i") + 1).cast("bigint").alias("step"), F.col("_s.date").alias("date"),
                        F.col("_s.sales").alias("forecasted_sales"))
