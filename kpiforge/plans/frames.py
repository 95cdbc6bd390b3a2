"""The two populations every report runs on, built from a table folder.

* ``raw_fact``: order lines as read (the dashboards' input).
* ``prepared_fact``: cleaned order lines (KPI tables and models' input).

Cleaning statistics are column-wise: fitted on the full fact, applied to
whatever columns a query reads. Fits are kept on the caller's session, by spec
and by the files (path, length, modification time) they came from, so changed
files are fitted again.
"""

from __future__ import annotations

import uuid
from hashlib import md5
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import CleaningStats, impute, iqr_bounds, prepare, with_date_features
from ..operators.partials import FILE, FilePartials, quantile_partials, sketched_ranks
from ..sources.tables import STAR_TABLES, columns_with_gaps, fact_columns, file_listing, sales_fact
from ..session import scratch_path
from ..spec import DEFAULT_SPEC, SalesSpec


def fitted_once(spark: SparkSession, sf_dir: str, what: tuple, make, fresh: bool = False):
    """``make()``, remembered on ``spark`` for the same files (``fresh``: made
    anew, and remembered)."""
    kept = spark.__dict__.setdefault("_kpiforge_fits", {})
    files = file_listing(spark, sf_dir)
    if fresh or kept.get(what, (None,))[0] != files:
        kept[what] = (files, make())
    return kept[what][1]


# Bytes of line item files for one partition of the reports that spread lines.
LINE_BYTES = 4 << 20


def line_partitions(spark: SparkSession, sf_dir: str) -> int:
    size = sum(f[1] for f in file_listing(spark, sf_dir, ["lineitem"]))
    return max(spark.sparkContext.defaultParallelism, -(-size // LINE_BYTES))


def raw_fact(spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None,
             spec: SalesSpec = DEFAULT_SPEC) -> DataFrame:
    return sales_fact(spark, sf_dir, columns, spec)


def fit_cleaning(spark: SparkSession, sf_dir: str,
                 spec: SalesSpec = DEFAULT_SPEC) -> CleaningStats:
    """Fills and bounds of both date-part variants (analysis and forecaster).

    The joined fact is evaluated once and written to the shared folder
    (``CleaningStats.lines``): the capped measures of every line and the columns
    that may hold nulls, which the tables tell without a join. The null counts,
    medians, modes and quartiles all read that file."""
    gaps = columns_with_gaps(spark, sf_dir, spec)
    if gaps & set(spec.dates):      # the lag needs both
        gaps |= set(spec.dates)
    cols = [c for c in fact_columns(spec) if c in gaps or c in spec.capped]
    wide, full = (with_date_features(sales_fact(spark, sf_dir, some, spec), spec, "strict", "all")
                  for some in (None, cols))
    path = scratch_path(spark, f"cleaning-{uuid.uuid4().hex}")
    full.write.parquet(path)
    full = spark.read.parquet(path)
    st = CleaningStats(lines=path)
    filled = impute(full, spec, st)
    st.null_counts = {c: st.null_counts.get(c, 0) for c in wide.columns}
    # one sketch per partition and column is cheaper than the first exact pass
    sketches = quantile_partials(filled.withColumn(FILE, F.spark_partition_id()), spec.capped)
    ranks = sketched_ranks(sketches, {c: (0.25, 0.75) for c in spec.capped})
    st.bounds = iqr_bounds(filled, list(spec.capped), brackets=ranks)
    st.fitted = True
    return st


def cleaning_stats(spark: SparkSession, sf_dir: str, spec: SalesSpec = DEFAULT_SPEC,
                   fresh: bool = False) -> CleaningStats:
    return fitted_once(spark, sf_dir, ("cleaning", sf_dir.rstrip("/"), spec),
                       lambda: fit_cleaning(spark, sf_dir, spec), fresh)


def line_partials(spark: SparkSession, sf_dir: str, name: str, columns: Iterable[str], aggregate,
                  frame=lambda lines: lines, depends_on: object = (),
                  spec: SalesSpec = DEFAULT_SPEC) -> tuple[DataFrame, list[str]]:
    """``aggregate`` of the order lines, kept per file of line items in the
    shared folder: (partial rows, files read this time). A change of any other
    table, or of ``depends_on``, makes all of them anew."""
    store = FilePartials(spark, scratch_path(spark, f"partials/{name}-{md5(sf_dir.rstrip('/').encode()).hexdigest()}"))
    others = file_listing(spark, sf_dir, [t for t in STAR_TABLES if t != "lineitem"])
    columns = list(columns)
    lines = [f for f in file_listing(spark, sf_dir, ["lineitem"])
             if not f[0].rpartition("/")[2].startswith(("_", "."))]
    return store.refresh(
        lines,
        lambda paths: frame(sales_fact(spark, sf_dir, columns, spec, line_files=paths)),
        aggregate, (others, depends_on, spec))


def measured_lines(spark: SparkSession, sf_dir: str, spec: SalesSpec = DEFAULT_SPEC) -> DataFrame:
    """The capped measures of every order line, imputed, as the fit wrote them:
    no join."""
    st = cleaning_stats(spark, sf_dir, spec)
    return impute(spark.read.parquet(st.lines).select(*spec.capped), spec, st)


def prepared_fact(spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None,
                  extra_parts: bool = False, spec: SalesSpec = DEFAULT_SPEC) -> DataFrame:
    st = cleaning_stats(spark, sf_dir, spec)
    return prepare(sales_fact(spark, sf_dir, columns, spec), spec,
                   extra_parts=extra_parts, stats=st)


# Fault injection for the imputation queries: the driver tables are complete,
# so gaps are made with a deterministic rule on the keys (the SQL oracle
# applies the same rule). Every row is kept; only values become null.
GAP_RULES = {
    "quantity": ("product_id", 17),
    "discount": ("customer_id", 11),
    "sales": ("order_id", 23),
    "segment": ("order_id", 13),
    "ship_mode": ("customer_id", 19),
}


def with_gaps(df: DataFrame) -> DataFrame:
    out = df
    for col, (key, m) in GAP_RULES.items():
        if col in df.columns:
            out = out.withColumn(col, F.when(F.col(key) % m == 0, F.lit(None))
                                 .otherwise(F.col(col)))
    return out
