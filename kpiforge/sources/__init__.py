"""Order-line sources and dataset sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import DEFAULT_SPEC, SalesSpec


def read_sales(spark: SparkSession, path: str, kind: str = "auto",
               spec: SalesSpec = DEFAULT_SPEC) -> DataFrame:
    """Order lines from a star-schema folder, a CSV export or a flat Parquet
    table (``kind="auto"`` decides from the path)."""
    from .csv import read_sales_csv
    from .tables import finite, sales_fact
    if kind == "auto":
        # any store that Spark reads, not only local folders
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = ([f.getPath().getName() for f in fs.listStatus(at)]
                 if fs.exists(at) and fs.getFileStatus(at).isDirectory() else [])
        if "lineitem.parquet" in names:
            kind = "star"
        elif path.lower().endswith(".csv") or any(n.lower().endswith(".csv") for n in names):
            kind = "csv"
        else:
            kind = "parquet"
    if kind == "star":
        return sales_fact(spark, path, None, spec)
    if kind == "csv":
        return read_sales_csv(spark, path)
    if kind == "parquet":
        flat = spark.read.parquet(path)
        return flat.select(*[finite(f"`{c}`").alias(c) if t in ("double", "float")
                             else F.col(f"`{c}`") for c, t in flat.dtypes])
    raise ValueError(f"unknown source kind {kind!r}")
