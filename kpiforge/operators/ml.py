"""Models: the row-level sales regressor and the monthly forecasters.

Two shapes of work, two strategies:

* The row-level model trains on every order line (the big table). It is a
  ``pyspark.ml`` pipeline model - StringIndexer/OneHotEncoder, standardized
  numerics, random forest. ``forest`` grows the trees as a distributed
  aggregation over the executors.
* Forecasters train on monthly feature tables: one row per month and key, i.e.
  short series whatever the input size. They live in ``forecast``: ``pyspark.ml``
  ensembles for one series, linear regressions of any number of series as one
  plan of built-in functions. Selection / forecasting are DataFrame operations.
  Feature tables are checkpointed to the shared checkpoint folder first
  (lineage cut, so a lost executor does not re-run the order-line
  aggregation).
"""

from __future__ import annotations

import decimal
import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ..functions.dates import month_label
from ..session import drop_scratch, scratch_path
from ..spec import DEFAULT_SPEC, SalesSpec
from . import forest, series

# --------------------------------------------------------------------------
# Split, scaling, encoding
# --------------------------------------------------------------------------

def hash_bucket(key: str | Column, buckets: int = 5) -> Column:
    """Deterministic bucket of a row key (first 32 bits of its MD5). Unlike
    ``randomSplit`` it does not depend on partitioning, so the split is the
    same on every run and in SQL."""
    k = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(k.cast("string")), 1, 8), 16, 10).cast("bigint") % buckets


def is_test_row(key: str | Column, buckets: int = 5) -> Column:
    """~1/buckets of the rows form the hold-out set (80/20 for 5)."""
    return hash_bucket(key, buckets) == 0


def standardize_params(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std per column (sklearn ``StandardScaler``), from
    exact decimal sums in one aggregate pass; a constant column gets scale 1."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("decimal(18,4)")
        aggs += [F.count(x).alias(f"n_{c}"), F.sum(x).alias(f"s_{c}"),
                 F.sum(x * x).alias(f"q_{c}")]
    row = df.agg(*aggs).first()
    out = {}
    for c in cols:
        n, s, q = row[f"n_{c}"], row[f"s_{c}"], row[f"q_{c}"]
        if not n:
            out[c] = (0.0, 1.0)
            continue
        with decimal.localcontext() as ctx:
            ctx.prec = 90  # n*q - s*s exactly
            var = float(n * q - s * s) / float(n) / float(n)
        std = math.sqrt(var) if var > 0 else 0.0
        out[c] = (float(s) / float(n), std if std > 0 else 1.0)
    return out


def standardized(cols: Sequence[str], params: dict[str, tuple[float, float]],
                 suffix: str = "") -> list[Column]:
    return [((F.col(c).cast("double") - F.lit(params[c][0])) / F.lit(params[c][1]))
            .alias(f"{c}{suffix}") for c in cols]


def model_inputs(df: DataFrame, spec: SalesSpec = DEFAULT_SPEC) -> tuple[list[str], list[str]]:
    """(numeric, categorical) feature columns: every column except the
    excluded ones, split by type (date parts count as numeric)."""
    skip = set(spec.model_exclusions())
    num, cat = [], []
    for f in df.schema.fields:
        if f.name in skip or f.name.startswith("_"):
            continue
        if isinstance(f.dataType, NumericType):
            num.append(f.name)
        elif isinstance(f.dataType, StringType):
            cat.append(f.name)
    return num, cat


def one_hot_levels(df: DataFrame, cat_cols: Sequence[str]) -> DataFrame:
    """feature, level, slot, rows: the one-hot vocabulary (alphabetical, as
    the fitted indexer orders it). One stacked aggregate, no per-column job."""
    if not cat_cols:
        raise ValueError("no categorical columns")
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("level")) for c in cat_cols]))
        .alias("p")).select("p.*").where(F.col("level").isNotNull())
    counts = long.groupBy("feature", "level").agg(F.count(F.lit(1)).cast("bigint").alias("rows"))
    slot = F.row_number().over(Window.partitionBy("feature").orderBy("level")) - 1
    return counts.select("feature", "level", slot.cast("bigint").alias("slot"), "rows")


def one_hot_encoder(cat_cols: Sequence[str]) -> Pipeline:
    """Encoder of ``cat_cols`` to vectors ``{column}__ohe``: one slot per level
    of the fitted rows, alphabetically; any other level is all zeros."""
    idx = [f"{c}__idx" for c in cat_cols]
    return Pipeline(stages=[
        StringIndexer(inputCols=list(cat_cols), outputCols=idx, handleInvalid="keep",
                      stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=idx, outputCols=[f"{c}__ohe" for c in cat_cols], dropLast=True)])


# --------------------------------------------------------------------------
# Error metrics
# --------------------------------------------------------------------------

def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """MAE, RMSE and R² of ``prediction`` against ``label`` (one row)."""
    e = F.col(label) - F.col(prediction)
    return (df.where(F.col(label).isNotNull() & F.col(prediction).isNotNull())
            .agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                 F.avg(F.abs(e)).alias("mae"),
                 F.sqrt(F.avg(e * e)).alias("rmse"),
                 F.sum(e * e).alias("_sse"),
                 F.var_pop(F.col(label)).alias("_var"))
            .select("n", "mae", "rmse",
                    (F.lit(1.0) - F.try_divide(F.col("_sse"), F.col("_var") * F.col("n")))
                    .alias("r2")))


# --------------------------------------------------------------------------
# Row-level sales model
# --------------------------------------------------------------------------

@dataclass
class SalesModel:
    pipeline: PipelineModel
    numeric: list[str]
    categorical: list[str]
    scaling: dict[str, tuple[float, float]]
    metrics: DataFrame
    importance: DataFrame

    def features(self, df: DataFrame) -> DataFrame:
        return df.select("*", *standardized(self.numeric, self.scaling, "__z"))

    def predict(self, df: DataFrame) -> DataFrame:
        return self.pipeline.transform(self.features(df))


def sales_encoding(num: Sequence[str], cat: Sequence[str]) -> Pipeline:
    """Scaled numerics (``{column}__z``) and one-hot categoricals as one vector."""
    stages = one_hot_encoder(cat).getStages() if cat else []
    return Pipeline(stages=[*stages, VectorAssembler(
        inputCols=[f"{c}__z" for c in num] + [f"{c}__ohe" for c in cat], outputCol="features")])


def feature_names(encoded: DataFrame, column: str = "features") -> list[str]:
    """Names of an assembled vector's slots, read from the attributes that the
    fitted stages left in its schema: the column, or ``{column}_{level}``."""
    found = {}
    for group in encoded.schema[column].metadata["ml_attr"]["attrs"].values():
        for attr in group:
            name = attr["name"]
            if "__ohe_" in name:
                name = "_".join(name.split("__ohe_", 1))
            found[attr["idx"]] = name.removesuffix("__z")
    return [found[i] for i in range(len(found))]


# Rows of one partition of the sales model's training table. Partitions follow
# the number of rows, not cores or file splits.
MODEL_ROWS = 1 << 20


def fit_sales_model(prepared: DataFrame, spec: SalesSpec = DEFAULT_SPEC,
                    num_trees: int = 100, max_depth: int = 30, seed: int = 42,
                    test_buckets: int = 5, partitions: int | None = None,
                    max_bins: int = 256, node_memory_mb: int = 1024,
                    categorical: Sequence[str] | None = None) -> SalesModel:
    """Random forest on the cleaned order lines: hash 80/20 split on the row
    id, numerics standardized with train statistics, categoricals one-hot
    encoded (all levels kept, an unseen level encodes as all zeros).

    Trees grow to ``max_depth`` (30 is the most that Spark allows; level-wise
    training cost grows with the depth, lower values are the caller's choice);
    every feature is tried at each split (``forest.grow``). ``node_memory_mb``
    bounds the statistics of the nodes that one pass splits.
    Bagging is seeded per partition, so rows are dealt by the hash of their id
    into parts whose number follows the rows, and ordered in them: the model
    depends neither on cores nor on file splits. Only ``categorical`` columns
    (default: the spec's roles) are one-hot encoded, so a free-text column's
    vocabulary never comes to the driver.
    """
    spark = prepared.sparkSession
    num, cat = model_inputs(prepared, spec)
    declared = spec.model_categoricals() if categorical is None else categorical
    cat = [c for c in cat if c in declared]
    path = scratch_path(spark, f"sales-model-{uuid.uuid4().hex}")
    lines = prepared.select(spec.row_id, *num, *cat, F.col(spec.sales).cast("double").alias("label"),
                            is_test_row(spec.row_id, test_buckets).alias("_is_test"))
    lines.write.parquet(path)
    data = spark.read.schema(lines.schema).parquet(path)
    parts = partitions or max(8, -(-data.count() // MODEL_ROWS))
    train = data.where(~F.col("_is_test"))
    n, low, high = train.agg(F.count(F.lit(1)), F.min("label"), F.max("label")).first()
    if not n:
        raise ValueError("no training rows")
    scaling = standardize_params(train, num)
    z = standardized(num, scaling, "__z")
    encoder = sales_encoding(num, cat).fit(train.select("*", *z))
    scaled = data.select("*", *z)
    levels = []
    if cat:
        scaled = encoder.stages[0].transform(scaled)
        levels = [len(found) for found in encoder.stages[0].labelsArray]
    train, test = scaled.where(~F.col("_is_test")), scaled.where(F.col("_is_test"))
    zs, idx = [f"{c}__z" for c in num], [f"{c}__idx" for c in cat]
    thresholds = forest.bin_edges(train, zs, min(max_bins, n))
    edges = [thresholds[c] for c in zs]
    layout = forest.Layout([len(e) + 1 for e in edges] + [k + 1 for k in levels], len(num))
    # labels between -1 and 1, the same for any order of the rows
    centre, scale = ((low + high) / 2, (high - low) / 2 or 1.0) if low is not None else (0.0, 1.0)
    rows = materialize(forest.blocks(train, spec.row_id, "label", layout, edges, zs, idx, parts, centre, scale))
    trees = forest.grow(rows, layout, num_trees, max_depth, seed, node_memory_mb)
    fitted = forest.to_model(spark, trees, layout, edges, centre, scale, {
        "labelCol": "label", "featuresCol": "features", "predictionCol": "prediction", "numTrees": num_trees,
        "maxDepth": max_depth, "seed": seed, "maxBins": max_bins, "featureSubsetStrategy": "all",
        "subsamplingRate": 1.0, "impurity": "variance"})
    model = PipelineModel(stages=[*encoder.stages, fitted])
    pred = forest.predict(test, [spec.row_id, "label"], zs, idx, layout, edges, trees, centre, scale)
    # sums of errors in one order, however the rows lie in files
    scored = pred.repartition(parts, spec.row_id).sortWithinPartitions(spec.row_id, "label", "prediction")
    m = regression_metrics(scored, "label", "prediction").first()
    metrics = spark.createDataFrame([tuple(m)], "n bigint, mae double, rmse double, r2 double")
    weights = fitted.featureImportances.toArray().tolist()
    names = feature_names(encoder.transform(data.select("*", *z)))
    importance = spark.createDataFrame(list(zip(names, map(float, weights), strict=True)),
                                       "feature string, importance double")
    drop_scratch(spark, path)
    return SalesModel(model, num, cat, scaling, metrics, importance)


# --------------------------------------------------------------------------
# Monthly forecasters
# --------------------------------------------------------------------------

def materialize(df: DataFrame, single: bool = False) -> DataFrame:
    """Cut the lineage of an intermediate table: reliable checkpoint to the
    shared checkpoint folder. ``single`` packs it into one partition (for a
    single series, a few hundred rows); a panel of many series keeps its
    partitioning."""
    from ..session import checkpoint_dir
    checkpoint_dir(df.sparkSession)  # the cluster's shared folder (set if unset locally)
    return (df.coalesce(1) if single else df).checkpoint(eager=True)


def fold_bounds(n: int, n_splits: int = series.N_SPLITS) -> list[tuple[int, int, int]]:
    """(fold, train_end, test_end) row positions of expanding-window folds."""
    t = n // (n_splits + 1)
    if t < 1:
        raise ValueError(f"{n} rows cannot make {n_splits} time-series folds")
    return [(k, n - (n_splits - k) * t, n - (n_splits - k) * t + t) for k in range(n_splits)]


def history_plus_forecast(history: DataFrame, fc: DataFrame,
                          keys: Sequence[str] = ()) -> DataFrame:
    """History and forecast in one table, flagged (chart input). In a panel
    only series with a forecast are kept."""
    h = history.select(*keys, "date", F.col("sales").cast("double").alias("sales"),
                       F.lit(False).alias("forecast"))
    if keys:
        h = h.join(fc.select(*keys).distinct(), list(keys), "left_semi")
    f = fc.select(*keys, "date", F.col("forecasted_sales").alias("sales"),
                  F.lit(True).alias("forecast"))
    return h.unionByName(f)


# --------------------------------------------------------------------------
# Selection among fitted models
# --------------------------------------------------------------------------

# Fold scores (fold >= 0), horizon predictions and importances (fold -1) of any
# forecaster, after the keys of its series.
FIT_SCHEMA = ("model string, fold int, train_size int, test_size int, rmse double, "
              "step bigint, date date, prediction double, feature string, "
              "importance double, error string")

CANDIDATE_ORDER = ("random_forest", "gradient_boosting", "linear_regression")


def cv_summary(fits: DataFrame, keys: Sequence[str] = (),
               order: Sequence[str] = CANDIDATE_ORDER) -> DataFrame:
    """Per (keys, model): folds scored, mean RMSE, and whether it is the
    selected model (lowest mean RMSE, the earlier candidate on a tie)."""
    keys = list(keys)
    ordinal = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    s = (fits.where(F.col("fold") >= 0).groupBy(*keys, "model")
         .agg(F.count("rmse").cast("int").alias("folds_scored"),
              F.avg("rmse").alias("mean_rmse")))
    rank = F.row_number().over((Window.partitionBy(*keys) if keys else Window.partitionBy())
                               .orderBy(F.col("mean_rmse").asc_nulls_last(), ordinal))
    return s.withColumn("selected", rank == 1)


def selected_forecast(fits: DataFrame, keys: Sequence[str] = (),
                      order: Sequence[str] = CANDIDATE_ORDER) -> DataFrame:
    """Horizon predictions of each series' selected model."""
    keys = list(keys)
    best = cv_summary(fits, keys, order).where("selected").select(*keys, "model")
    preds = fits.where((F.col("fold") == -1) & F.col("step").isNotNull())
    return (preds.join(best, keys + ["model"], "left_semi")
            .select(*keys, "model", "step", "date", month_label("date").alias("label"),
                    F.col("prediction").alias("forecasted_sales")))


def selected_importance(fits: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Feature importances of the selected model (empty if it is linear)."""
    keys = list(keys)
    best = cv_summary(fits, keys).where("selected").select(*keys, "model")
    imp = fits.where((F.col("fold") == -1) & F.col("feature").isNotNull())
    return imp.join(best, keys + ["model"], "left_semi").select(*keys, "model", "feature",
                                                                "importance")


def forecast_series(features: DataFrame, horizon: int = 3, keys: Sequence[str] = (),
                    models: Sequence[str] | None = None, step: str = "30d",
                    spec: SalesSpec = DEFAULT_SPEC) -> tuple[DataFrame, DataFrame]:
    """One call from a feature table to (model summary, forecast).

    Global series: the three candidates are cross-validated and the best one
    forecasts; these fits run at the call. Keyed panel (``keys=[category]``):
    a linear regression per key, folds with < 5 train / < 2 test rows skipped;
    nothing runs until the results are used. ``models`` of a panel other than
    the linear one are fitted key by key (``forecast.panel_fits``)."""
    from .forecast import CANDIDATES, LINEAR, linear_fits, panel_fits, series_fits

    keys = list(keys)
    if keys:
        fut = series.future_features(features, horizon, keys, series.CATEGORY_LAGS,
                                     series.CATEGORY_LAG_MEASURES, series.CATEGORY_WINDOWS,
                                     with_std=False, require_full_window=True, step=step)
        if models is None or list(models) == [LINEAR]:
            fits = linear_fits(features, fut, keys, min_train=5, min_test=2)
        else:
            fits = materialize(panel_fits(features, fut, *keys, models, min_train=5, min_test=2))
    else:
        fut = series.future_features(features, horizon, step=step)
        fits = materialize(series_fits(features, fut, list(models or CANDIDATES)), single=True)
    return cv_summary(fits, keys), selected_forecast(fits, keys)
