"""Linear regression of any number of short series from sums of products.

The training rows of expanding folds are nested, so one pass gives them all: a
row adds the products of its columns to the sums of its segment (the rows
between two fold starts), and a fold's normal equations are the running total of
the segments. Sums are exact (columns are scaled by their largest value to whole
numbers), pre-aggregated, and a fit ends as one small matrix per series and
fold that is solved where it lies: no rows are collected and no Python runs.

``solve`` is Gauss-Jordan elimination by sweeps. A column that depends on the
ones before it is not swept; of all coefficient vectors with the same errors the
one of least length is taken, as a least-squares solver on the rows would give
for more features than rows. A dependent column whose part in that length is
lost to rounding gets 0, which leaves the errors as they are. Constant columns
get 0, columns that a series never observed get none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import series

# Columns are whole multiples of their largest value / GRID; products of two
# such numbers and their sums stay exact.
GRID = 1e10
# A column whose variance is explained by the ones before it up to this share
# counts as dependent on them.
DEPENDENT = 1e-10
CONSTANT = 1e-12
# A smaller weight of a column in a dependent one is what the grid rounds.
SHARE = 1e-6
# What is left of a sum of squares below this share of it is rounding.
ROUNDING = 1e-14


def sweep(m: Column, k: Column) -> Column:
    """The matrix after sweeping row and column ``k``."""
    pivot_row, d = m[k], m[k][k]

    def cell(row, i):
        return lambda x, j: (F.when((i == k) & (j == k), F.lit(1.0) / d)
                             .when(i == k, x / d).when(j == k, -x / d)
                             .otherwise(x - row[k] * pivot_row[j] / d))

    return F.transform(m, lambda row, i: F.transform(row, cell(row, i)))


def _sum(items: Column, term) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + term(x))


def product_sums(rows: DataFrame, keys: Sequence[str], features: Sequence[str], label: str,
                 n_splits: int) -> DataFrame:
    """One row per series: its length, the scale of every column (null where
    none was observed), and for each pair of columns (constant, features, label)
    the sums of products over segments 0 to ``n_splits``. Series that hold a
    number that is not finite are left out."""
    keys = list(keys)
    whole = Window.partitionBy(*keys)
    names = [*features, label]
    x = {c: F.col(c).cast("double") for c in names}
    base = rows.select(
        *keys, (F.row_number().over(whole.orderBy("date")) - 1).alias("_rn"),
        F.count(F.lit(1)).over(whole).alias("_n"),
        F.array(*[x[c] for c in names]).alias("_x"),
        F.array(*[F.max(F.abs(x[c])).over(whole) for c in names]).alias("_unit"))
    # infinity and NaN are the largest of their column
    base = base.where(F.forall("_unit", lambda u: u.isNull() | ~(F.isnan(u) | (u == float("inf")))))
    t = F.floor(F.col("_n") / (n_splits + 1))
    started = [(F.col("_rn") >= F.col("_n") - (n_splits - f) * t).cast("int") for f in range(n_splits)]
    whole_numbers = F.zip_with("_x", "_unit", lambda v, u: F.when(
        v.isNotNull() & (u > 0), F.floor(v / u * GRID + 0.5)).otherwise(0).cast("decimal(11,0)"))
    z = base.select(*keys, "_n", "_unit", F.when(t >= 1, sum(started, F.lit(0))).otherwise(0).alias("_seg"),
                    F.concat(F.array(F.lit(int(GRID)).cast("decimal(11,0)")), whole_numbers).alias("_z"))
    pairs = F.flatten(F.transform("_z", lambda a, i: F.transform(
        F.slice("_z", i + 1, F.lit(len(names) + 1)),
        lambda b, j: F.struct(i.alias("i"), (i + j).alias("j"), (a * b).alias("v")))))
    sums = (z.select(*keys, "_n", "_unit", "_seg", F.explode(pairs).alias("_p"))
            .groupBy(*keys, F.col("_p.i").alias("i"), F.col("_p.j").alias("j"))
            .agg(F.first("_n").alias("_n"), F.first("_unit").alias("_unit"),
                 F.array(*[F.coalesce(F.sum(F.when(F.col("_seg") == s, F.col("_p.v"))),
                                      F.lit(0).cast("decimal(33,0)")) for s in range(n_splits + 1)])
                 .alias("s")))
    return sums.groupBy(*keys).agg(
        F.first("_n").alias("_n"), F.first("_unit").alias("_unit"),
        F.array_sort(F.collect_list(F.struct("i", "j", "s"))).alias("_sums"))


def _matrix(size: int, segments: Column) -> Column:
    """Product sums over the first ``segments`` segments, as a full matrix."""
    at = lambda i, j: (i * size - (i * (i - 1) / 2).cast("int") + j - i)
    total = lambda p: F.aggregate(F.slice(p["s"], 1, segments),
                                  F.lit(0).cast("decimal(38,0)"), lambda a, v: (a + v).cast("decimal(38,0)"))
    axis = F.sequence(F.lit(0), F.lit(size - 1))
    part = F.lit(10 ** 12).cast("decimal(13,0)")

    def number(v: Column) -> Column:
        """The sum as a double, in two exact parts."""
        return F.call_function("div", v, part).cast("double") * F.lit(1e12) + (v % part).cast("double")

    return F.transform(axis, lambda i: F.transform(
        axis, lambda j: number(total(F.col("_sums")[at(F.least(i, j), F.greatest(i, j))]))
        / (GRID * GRID)))


def solve(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows with ``_m`` (product sums) and ``_unit`` -> with ``intercept`` and
    ``coefficients`` (in the order of ``features``)."""
    p = len(features)
    y = p + 1
    columns = F.sequence(F.lit(1), F.lit(p))
    m = F.col("_m")
    # the constant first: what is left on the diagonal are the variances
    df = df.withColumn("_c", sweep(m, F.lit(0)))
    spread = F.transform(F.sequence(F.lit(0), F.lit(y)), lambda k: F.when(
        F.col("_c")[k][k] > CONSTANT * m[k][k], F.col("_c")[k][k]))
    df = df.withColumn("_var", spread)
    start = F.struct(F.col("_c").alias("m"), F.array().cast("array<int>").alias("used"))

    def step(state: Column, k: Column) -> Column:
        take = state["m"][k][k] > DEPENDENT * F.col("_var")[k]
        return F.struct(F.when(take, sweep(state["m"], k)).otherwise(state["m"]).alias("m"),
                        F.when(take, F.array_append(state["used"], k)).otherwise(state["used"])
                        .alias("used"))

    # large columns first: what depends on them then weighs little in the length
    order = F.transform(F.array_sort(F.transform(columns, lambda k: F.struct(
        (-F.coalesce(F.col("_unit")[k - 1], F.lit(0.0))).alias("u"), k.alias("k")))), lambda o: o["k"])
    df = df.withColumn("_s", F.aggregate(order, start, step))
    df = df.select("*", F.col("_s.m").alias("_b"), F.col("_s.used").alias("_used"),
                   F.filter(columns, lambda k: F.col("_var")[k].isNotNull()
                            & ~F.array_contains(F.col("_s.used"), k)).alias("_rest"))
    # dependent columns share the work so that the vector is shortest
    b, used, rest, unit = F.col("_b"), F.col("_used"), F.col("_rest"), F.col("_unit")
    weight = lambda k: F.lit(1.0) / (unit[k - 1] * unit[k - 1])
    axis = F.sequence(F.lit(0), F.lit(y))
    share = lambda k, r: F.when(F.abs(b[k][r]) > SHARE, b[k][r]).otherwise(0.0)
    right = lambda k, j: F.when(j == y, b[k][y]).otherwise(share(k, j))
    gram = F.transform(axis, lambda i: F.transform(axis, lambda j: F.when(
        F.array_contains(rest, i) & (F.array_contains(rest, j) | (j == y)),
        _sum(used, lambda k: weight(k) * share(k, i) * right(k, j))
        + F.when(i == j, weight(i)).otherwise(0.0)).otherwise(0.0)))
    df = df.withColumn("_g", gram)

    def settle(state: Column, k: Column) -> Column:
        d = state["m"][k][k]
        # weights plus a square: no pivot is below its column's weight
        take = (d > weight(k) / 2) & (d > ROUNDING * F.col("_g")[k][k])
        return F.struct(F.when(take, sweep(state["m"], k)).otherwise(state["m"]).alias("m"),
                        F.when(take, F.array_append(state["used"], k)).otherwise(state["used"]).alias("used"))

    df = df.withColumn("_h", F.aggregate(
        rest, F.struct(F.col("_g").alias("m"), F.array().cast("array<int>").alias("used")), settle))
    g, rest = F.col("_h.m"), F.col("_h.used")
    own = lambda k: b[k][y] - _sum(rest, lambda r: share(k, r) * g[r][y])
    df = df.withColumn("_t", F.transform(columns, lambda k: F.when(
        F.array_contains(used, k), own(k)).when(F.array_contains(rest, k), g[k][y]).otherwise(0.0)))
    scale = unit[p]
    return (df.withColumn("intercept", own(F.lit(0)) * scale)
            .withColumn("coefficients", F.transform(columns, lambda k: F.when(
                unit[k - 1].isNotNull(), F.when(unit[k - 1] > 0, F.col("_t")[k - 1] * scale / unit[k - 1])
                .otherwise(0.0))))
            .drop("_m", "_c", "_var", "_s", "_b", "_used", "_rest", "_g", "_h", "_t"))


def linear_models(features: DataFrame, keys: Sequence[str] = (), label: str = "sales",
                  n_splits: int = series.N_SPLITS, min_train: int = 0,
                  min_test: int = 0) -> DataFrame:
    """(keys, fold, train_size, test_size, intercept, coefficients): a model per
    fold and, for each series with a scored fold, one of all rows (fold -1). A
    single series too short for its folds raises, one of a panel has no model."""
    keys = list(keys)
    names = series.feature_columns(features, keys)
    sums = product_sums(features, keys, names, label, n_splits)
    t = series.fold_size(F.col("_n"), n_splits, keys)
    folds = F.transform(F.sequence(F.lit(0), F.lit(n_splits - 1)), lambda f: F.struct(
        f.alias("fold"), (F.col("_n") - (F.lit(n_splits) - f) * F.col("_t")).cast("int").alias("train_size"),
        F.col("_t").cast("int").alias("test_size")))
    scored = F.filter(folds, lambda f: (f["train_size"] >= min_train) & (f["test_size"] >= min_test))
    final = F.struct(F.lit(-1).alias("fold"), F.col("_n").cast("int").alias("train_size"),
                     F.lit(0).alias("test_size"))
    each = (sums.withColumn("_t", t).where(F.col("_t") >= 1)
            .withColumn("_f", scored).where(F.size("_f") > 0)
            .withColumn("_f", F.explode(F.concat("_f", F.array(final))))
            .select("*", "_f.*").drop("_f", "_t"))
    segments = F.when(F.col("fold") < 0, n_splits + 1).otherwise(F.col("fold") + 1)
    made = solve(each.withColumn("_m", _matrix(len(names) + 2, segments)), names)
    return made.select(*keys, "fold", "train_size", "test_size", "intercept", "coefficients")


def predicted(features: Sequence[str]) -> Column:
    """Prediction of a row that holds ``features`` and its model's columns; null
    where a feature that the model uses is missing."""
    x = F.array(*[F.col(c).cast("double") for c in features])
    terms = F.zip_with("coefficients", x, lambda c, v: F.when(c.isNull(), F.lit(0.0)).otherwise(c * v))
    return F.aggregate(terms, F.col("intercept"), lambda acc, v: acc + v)


def coefficient_rows(models: DataFrame, features: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, fold, term, coefficient): tidy models; the term of a feature that a
    series never observed is left out."""
    names = series.feature_columns(features, keys)
    terms = F.array(F.struct(F.lit("intercept").alias("term"), F.col("intercept").alias("coefficient")),
                    *[F.struct(F.lit(c).alias("term"), F.col("coefficients")[i].alias("coefficient"))
                      for i, c in enumerate(names)])
    return (models.select(*keys, "fold", F.explode(terms).alias("_t")).select(*keys, "fold", "_t.*")
            .where("coefficient is not null"))
