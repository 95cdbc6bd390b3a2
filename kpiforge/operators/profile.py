"""Table profile: shape, per-column type and completeness, sample rows.

One aggregate pass computes every column's non-null count; the result is
unpivoted to one row per column (the ``info()`` view of a table).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shape(df: DataFrame) -> DataFrame:
    """rows, columns (one row)."""
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("rows")).select(
        "rows", F.lit(len(df.columns)).cast("bigint").alias("columns"))


def column_profile(df: DataFrame) -> DataFrame:
    """column, position, dtype, non_null, nulls - every column in one pass."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count(F.col(f"`{c}`")).alias(f"_nn{i}") for i, c in enumerate(cols)])
    types = dict(df.dtypes)
    rows = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(i).cast("bigint").alias("position"),
                 F.lit(types[c]).alias("dtype"),
                 F.col(f"_nn{i}").cast("bigint").alias("non_null"))
        for i, c in enumerate(cols)]))
    return (agg.select(F.col("_rows"), rows.alias("p"))
            .select("p.*", (F.col("_rows") - F.col("p.non_null")).cast("bigint").alias("nulls")))


def sample_rows(df: DataFrame, n: int = 5, order: str | None = None) -> DataFrame:
    """``n`` rows (a peek, like ``head``): the first by ``order`` if given."""
    return (df if order is None else df.orderBy(order)).limit(n)
