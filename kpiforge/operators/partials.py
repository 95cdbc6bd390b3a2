"""Aggregates kept per input file and merged: unchanged files are not read again.

``FilePartials`` keeps the rows of a partial aggregate in a folder, tagged with
the state of the file they came from (path, length, modification time, and
whatever else they depend on). A refresh reads only files whose state is not
there yet, in one job. A mark is written after a run's rows, so a run that dies
half-way leaves rows without a mark, which no one reads.

What may be kept this way is any aggregate that merges: exact sums and counts
(``monthly_partials``), quantile sketches and distinct-count sketches.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.measures import MONEY
from ..spec import DEFAULT_SPEC, SalesSpec

FILE = "_file"

Listing = Iterable[tuple[str, int, int]]


class FilePartials:
    """Partial rows of files in ``folder`` (on storage that all executors see)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _exists(self, path: str) -> bool:
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf).exists(p)

    def refresh(self, files: Listing, read: Callable[[list[str]], DataFrame],
                aggregate: Callable[[DataFrame], DataFrame],
                depends_on: object = ()) -> tuple[DataFrame, list[str]]:
        """(partial rows of ``files`` as they are now, paths that were read).

        ``read(paths)`` gives the rows of some files with their path in the
        column ``_file``; ``aggregate(rows)`` groups by it. ``depends_on``: state
        besides the files that the rows depend on."""
        state = {path: hashlib.sha256(repr((path, size, time, depends_on)).encode()).hexdigest()
                 for path, size, time in files}
        marks = f"{self.folder}/marks"
        known = {}
        if self._exists(marks):
            known = {r["state"]: r["run"] for r in self.spark.read.parquet(marks).collect()}
        missing = [path for path, s in state.items() if s not in known]
        if missing:
            run = uuid.uuid4().hex
            aggregate(read(missing)).write.parquet(f"{self.folder}/rows/run={run}")
            done = self.spark.createDataFrame([(state[p], p, run) for p in missing],
                                              "state string, path string, run string")
            done.coalesce(1).write.mode("append").parquet(marks)
            known |= {state[p]: run for p in missing}
        # one small row for each file
        current = self.spark.createDataFrame([(known[s], p) for p, s in state.items()],
                                             f"run string, {FILE} string")
        rows = self.spark.read.parquet(f"{self.folder}/rows")
        return rows.join(current, ["run", FILE], "left_semi").drop("run", FILE), missing


# -- monthly sums ------------------------------------------------------------

def monthly_partials(df: DataFrame, keys: Sequence[str] = (), spec: SalesSpec = DEFAULT_SPEC) -> DataFrame:
    """Exact sums and counts per (file, keys, year, month) that merge to
    ``series.monthly_series``."""
    d = F.col(spec.order_date)
    keyed = df.where(d.isNotNull())
    for k in keys:
        keyed = keyed.where(F.col(k).isNotNull())
    total = lambda c: F.coalesce(F.sum(F.col(c).cast(MONEY)), F.lit(0).cast(MONEY))
    return (keyed.groupBy(FILE, *keys, F.year(d).cast("bigint").alias("year"),
                          F.month(d).cast("bigint").alias("month"))
            .agg(total(spec.sales).alias("sales"), total(spec.profit).alias("profit"),
                 total(spec.quantity).alias("quantity"), F.sum(F.col(spec.discount).cast(MONEY)).alias("discount"),
                 F.count(spec.discount).alias("discounts"), F.count(spec.order_id).alias("orders")))


def merged_months(partials: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``monthly_partials`` of any files -> the columns of ``monthly_series``."""
    m = partials.groupBy(*keys, "year", "month").agg(
        *[F.sum(c).alias(c) for c in ("sales", "profit", "quantity", "discount", "discounts", "orders")])
    number = lambda c: F.col(c).cast("double").alias(c)
    return m.select(*keys, "year", "month", F.make_date("year", "month", F.lit(1)).alias("date"),
                    number("sales"), number("profit"), number("quantity"),
                    F.try_divide(F.col("discount").cast("double"), F.col("discounts").cast("double"))
                    .alias("avg_discount"), F.col("orders").cast("bigint").alias("order_count"),
                    F.col("sales").cast(MONEY).alias("_sales_dec"))


# -- quantile sketches -------------------------------------------------------

# KLL sketch size; ranks are off by at most RANK_ERROR of the rows.
KLL_K = 8192
RANK_ERROR = 0.0015


def quantile_partials(df: DataFrame, cols: Sequence[str], k: int = KLL_K) -> DataFrame:
    """One KLL sketch per file and column."""
    return df.groupBy(FILE).agg(*[F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(k)).alias(c)
                                  for c in cols])


def sketched_ranks(partials: DataFrame, targets: dict[str, Sequence[float]],
                   error: float = RANK_ERROR) -> dict[str, tuple[int, list[float]]]:
    """Column -> (rows, values around every probability): what
    ``stats.exact_quantiles`` starts from instead of a pass of its own."""
    merged = partials.agg(*[F.kll_merge_agg_double(c).alias(c) for c in targets])
    wanted = []
    for c, probs in targets.items():
        around = [x for p in probs for x in (max(0.0, p - error), min(1.0, p + error))]
        n = F.kll_sketch_get_n_double(c)
        wanted += [n.alias(f"n_{c}"), F.when(n > 0, F.kll_sketch_get_quantile_double(
            c, F.array(*[F.lit(x) for x in around]))).alias(f"q_{c}")]
    row = merged.select(*wanted).first()
    return {c: (int(row[f"n_{c}"] or 0), list(row[f"q_{c}"] or [])) for c in targets}


# -- distinct counts ---------------------------------------------------------

# log2 of the theta sketch's entries: exact up to that many different values,
# beyond it off by about 1 / sqrt(entries).
THETA_LG = 16


def distinct_partials(df: DataFrame, keys: Sequence[str], ids: Sequence[str], date: str,
                      lg: int = THETA_LG) -> DataFrame:
    """(keys, year, month) -> one theta sketch per id column; with a column
    ``_file`` per file too."""
    by = [FILE] * (FILE in df.columns) + list(keys)
    return (df.groupBy(*by, F.year(date).cast("bigint").alias("year"), F.month(date).cast("bigint").alias("month"))
            .agg(*[F.theta_sketch_agg(F.col(c), lg).alias(c) for c in ids]))


def distinct_rollup(partials: DataFrame, keys: Sequence[str | Column], ids: Sequence[str],
                    lg: int = THETA_LG) -> DataFrame:
    """Months (and files) united to ``keys``: the number of different ids."""
    return partials.groupBy(*keys).agg(
        *[F.theta_sketch_estimate(F.theta_union_agg(F.col(c), lg)).cast("bigint").alias(c) for c in ids])
