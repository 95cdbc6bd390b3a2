"""Forecasters of one series or a panel, and closed-form predictors.

``series_fits`` cross-validates and refits the candidate models of a single
series: tree ensembles with ``pyspark.ml`` (a fixed number of fits, models x
(folds + 1), submitted from a bounded pool of threads so that Spark runs their
many small jobs side by side), linear regression from product sums.

``linear_fits`` does the latter for any number of series at once, as a plan of
built-in functions. ``panel_fits`` runs ``series_fits`` for each series of a
panel that is declared small. The caller chooses by the call, never the size.

``predictor_fits`` scores predictors that are a feature column themselves (last
month, trailing mean): the baselines a fitted model has to beat.

All of them return the rows of ``ml.FIT_SCHEMA``, which ``ml.cv_summary``,
``ml.selected_forecast`` and ``ml.selected_importance`` read.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import leastsq, ml, series

LINEAR = "linear_regression"
ENSEMBLES: dict[str, Callable] = {
    "random_forest": lambda bins: RandomForestRegressor(
        numTrees=100, maxDepth=30, maxBins=bins, featureSubsetStrategy="all", seed=42),
    "gradient_boosting": lambda bins: GBTRegressor(
        maxIter=100, maxDepth=3, stepSize=0.1, maxBins=bins, featureSubsetStrategy="all",
        checkpointInterval=-1, seed=42),
}
CANDIDATES = (*ENSEMBLES, LINEAR)


def _result(df: DataFrame, keys: Sequence[str] = (), **known) -> DataFrame:
    """``df`` (and literal columns) in the layout of ``ml.FIT_SCHEMA``."""
    cols = []
    for part in ml.FIT_SCHEMA.split(", "):
        name, kind = part.split()
        c = F.col(name) if name in df.columns else F.lit(known.get(name))
        cols.append(c.cast(kind).alias(name))
    return df.select(*keys, *cols)


def _fit(name: str, fold: int, train: DataFrame, other: DataFrame, used: list[str],
         bins: int) -> DataFrame:
    """One fit: the score of a fold, or (fold -1) the horizon and importances."""
    model = ENSEMBLES[name](bins).setFeaturesCol("_x").setLabelCol("_y").fit(train)
    size = {"model": name, "fold": fold, "train_size": train.count()}
    scored = model.transform(other)
    if fold >= 0:
        e = F.col("_y") - F.col("prediction")
        return _result(scored.agg(F.sqrt(F.avg(e * e)).alias("rmse"),
                                  F.count(F.lit(1)).alias("test_size")), **size)
    out = _result(scored, test_size=0, **size)
    if hasattr(model, "featureImportances"):
        weights = [float(v) for v in model.featureImportances.toArray()]
        rows = train.sparkSession.createDataFrame(list(zip(used, weights)),
                                                  "feature string, importance double")
        out = out.unionByName(_result(rows, test_size=0, **size))
    return out


def series_fits(features: DataFrame, future: DataFrame, models: Sequence[str] = CANDIDATES,
                label: str = "sales", n_splits: int = series.N_SPLITS, min_train: int = 0,
                min_test: int = 0, threads: int = 8) -> DataFrame:
    """Fold scores and horizon predictions of each model for one series.

    ``features`` is one row per month, so every fit reads one small partition;
    each distinct value may be a split point (as many bins as rows). A feature
    never observed (series shorter than its lag) is left out; a horizon row
    missing an input gets no prediction; a failing fit gives a row with its
    error. A series too short for its folds raises.
    """
    names = series.feature_columns(features)
    base = ml.materialize(features.select("date", *[F.col(c).cast("double").alias(c) for c in names],
                                          F.col(label).cast("double").alias("_y"))
                          .withColumn("_rn", F.row_number().over(
                              Window.partitionBy().orderBy("date")) - 1), single=True)
    n, *seen = base.agg(F.count(F.lit(1)), *[F.count(c) for c in names]).first()
    folds = [b for b in ml.fold_bounds(n, n_splits)
             if b[1] >= min_train and b[2] - b[1] >= min_test]
    used = [c for c, k in zip(names, seen) if k]
    assemble = VectorAssembler(inputCols=used, outputCol="_x")
    rows = ml.materialize(assemble.transform(base).select("date", "_rn", "_x", "_y"), single=True)
    wanted = future.select("step", "date", *[F.col(c).cast("double").alias(c) for c in used])
    horizon = ml.materialize(assemble.transform(wanted.na.drop(subset=used))
                             .select("step", "date", "_x"), single=True)

    def work(task: tuple[str, tuple[int, int, int]]) -> DataFrame:
        name, (fold, start, end) = task
        train = rows.where(F.col("_rn") < start)
        other = horizon if fold < 0 else rows.where(F.col("_rn").between(start, end - 1))
        try:
            return _fit(name, fold, train, other, used, max(n, 2))
        except Exception as e:  # one failing fit must not end the others
            return _result(rows.sparkSession.range(1), model=name, fold=fold, train_size=start,
                           test_size=0, error=f"{type(e).__name__}: {e}"[:500])

    tasks = [(m, f) for f in [(-1, n, n), *reversed(folds)]
             for m in sorted(models, key=lambda m: m != "gradient_boosting") if m != LINEAR]
    with ThreadPoolExecutor(max_workers=threads) as pool:
        parts = list(pool.map(inheritable_thread_target(rows.sparkSession)(work), tasks))
    if LINEAR in models:
        parts.append(linear_fits(features, future, (), label, n_splits, min_train, min_test))
    return reduce(DataFrame.unionByName, parts)


def linear_fits(features: DataFrame, future: DataFrame, keys: Sequence[str] = (),
                label: str = "sales", n_splits: int = series.N_SPLITS, min_train: int = 0,
                min_test: int = 0) -> DataFrame:
    """Fold scores and horizon values of a linear regression per series: one plan
    of built-in functions, whatever the number of series. A horizon row that
    misses a feature of its model gets no value; a series with a number that is
    not finite gives a row with its error."""
    keys = list(keys)
    names = series.feature_columns(features, keys)
    absent = [F.lit(None).cast("double").alias(c) for c in names if c not in future.columns]
    future = future.select("*", *absent)
    models = leastsq.linear_models(features, keys, label, n_splits, min_train, min_test)
    rows = features.select(*keys, "date", *names, F.col(label).cast("double").alias("_y"))
    folds = series.ts_folds(features, keys, n_splits, min_train, min_test).where("role = 'test'")
    tested = (folds.select(*keys, "date", F.col("fold").cast("int").alias("fold"))
              .join(rows, [*keys, "date"]).join(models, [*keys, "fold"]))
    e = F.col("_y") - leastsq.predicted(names)
    scores = (tested.select(*keys, "fold", "train_size", "test_size", e.alias("_e"))
              .groupBy(*keys, "fold", "train_size", "test_size")
              .agg(F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse")))
    ahead = (future.withColumn("fold", F.lit(-1)).join(models, [*keys, "fold"])
             .withColumn("prediction", leastsq.predicted(names)).where("prediction is not null"))
    odd = [F.isnan(c) | (F.abs(c) == float("inf")) for c in (F.col(n).cast("double") for n in [*names, label])]
    broken = (features.where(reduce(Column.__or__, odd)).groupBy(*keys)
              .agg(F.count(F.lit(1)).alias("train_size")).where("train_size > 0"))
    parts = (_result(scores, keys, model=LINEAR), _result(ahead, keys, model=LINEAR, fold=-1),
             _result(broken, keys, model=LINEAR, fold=-1, error="ValueError: numbers that are not finite"))
    return reduce(DataFrame.unionByName, parts)


def panel_fits(features: DataFrame, future: DataFrame, key: str,
               models: Sequence[str] = ("gradient_boosting",), min_train: int = 0,
               min_test: int = 0, most_series: int = 32, **options) -> DataFrame:
    """``series_fits`` for every series of a panel with at most ``most_series``
    keys (more raise: such panels are for ``linear_fits``). A series too short
    for its folds has no rows; one without a scored fold has no model."""
    found = features.groupBy(key).agg(F.count(F.lit(1)).alias("n")).limit(most_series + 1).collect()
    if len(found) > most_series:
        raise ValueError(f"more than {most_series} series: use linear_fits")
    parts = []
    for r in found:
        bounds = ml.fold_bounds(r["n"]) if r["n"] > series.N_SPLITS else []
        if any(b[1] >= min_train and b[2] - b[1] >= min_test for b in bounds):
            own = [df.where(F.col(key) == r[key]).drop(key) for df in (features, future)]
            parts.append(series_fits(*own, models, min_train=min_train, min_test=min_test, **options)
                         .select(F.lit(r[key]).alias(key), "*"))
    if not parts:
        return features.sparkSession.createDataFrame([], f"{key} string, {ml.FIT_SCHEMA}")
    return reduce(DataFrame.unionByName, parts)


def predictor_fits(features: DataFrame, future: DataFrame, predictors: Mapping[str, str],
                   keys: Sequence[str] = (), label: str = "sales",
                   n_splits: int = series.N_SPLITS, min_train: int = 0,
                   min_test: int = 0) -> DataFrame:
    """Fold scores and horizon values of ``predictors`` (name -> feature column).

    A plan of built-in functions over the monthly rows. In a panel only series
    with a scored fold get a forecast."""
    keys = list(keys)

    def each(df: DataFrame, *cols) -> DataFrame:
        told = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("prediction"))
                         for m, c in predictors.items()])
        return df.select(*keys, *cols, F.explode(told).alias("_p")).select("*", "_p.*").drop("_p")

    folds = series.ts_folds(features, keys, n_splits, min_train, min_test).where("role = 'test'")
    tested = each(folds.join(features, [*keys, "date"]), "fold", "train_size", "test_size",
                  F.col(label).cast("double").alias("_y"))
    e = F.col("_y") - F.col("prediction")
    scores = _result(tested.groupBy(*keys, "model", "fold", "train_size", "test_size")
                     .agg(F.sqrt(F.avg(e * e)).alias("rmse")), keys)
    ahead = future.join(folds.select(*keys).distinct(), keys, "left_semi") if keys else future
    sizes = features.groupBy(*keys).agg(F.count(F.lit(1)).alias("train_size"))
    ahead = ahead.join(sizes, keys) if keys else ahead.withColumn("train_size", F.lit(None))
    told = each(ahead, "step", "date", "train_size").where("prediction is not null")
    return scores.unionByName(_result(told, keys, fold=-1, test_size=0))
