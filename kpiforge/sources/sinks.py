"""Dataset sinks: every report table is written as a table, not a picture.

A chart page of the reference becomes a Parquet (or JSON/CSV) dataset that
any charting tool can read; the catalog lists them with readable titles.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.measures import title_label

FORMATS = ("parquet", "json", "csv")


def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                partition_by: list[str] | None = None) -> str:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True)
    getattr(w, fmt)(path)
    return path


def catalog(spark: SparkSession, entries: list[tuple[str, str, str]]) -> DataFrame:
    """(section, name, path) rows -> section, name, title, path; the title is
    the name with underscores as spaces in title case."""
    df = spark.createDataFrame(entries, "section string, name string, path string")
    return df.select("section", "name", title_label(F.col("name")).alias("title"), "path")


def dataset_path(out_dir: str, name: str) -> str:
    return os.path.join(out_dir, name)
