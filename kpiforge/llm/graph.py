"""Connected components by alternating large-star and small-star steps.

Every step is a pre-aggregated minimum per node and one join, so a node with
any number of links is neither collected nor ranked in one task; the number of
rounds grows with the logarithm of the longest chain. Each round is written to
the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _round(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with u > v -> the edges after a large and a small star."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = (both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
             .filter("u <> v").distinct())
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(low, "u")
    return (moved.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct())


def components(edges: DataFrame) -> DataFrame:
    """(u, v) edges of any direction -> (node, label): every node that has an
    edge to another node, with the smallest node of its component."""
    now = materialise(edges.filter("u <> v")
                      .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                      .distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        now = materialise(_round(now), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
