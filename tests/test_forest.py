"""The random forest of the sales model against Spark ML's trees and its own tables."""

import numpy as np
import pytest
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from kpiforge.operators import forest, ml

TREES = 3
SCHEMA = "row_id string, quantity double, discount double, category string, segment string, sales double"


def _lines(spark, n=2500):
    """Whole labels, so that sums are exact; ``segment`` is null at times."""
    r = np.random.default_rng(7)
    q, d, c, s = r.integers(1, 50, n), r.integers(0, 6, n), r.integers(0, 4, n), r.integers(0, 3, n)
    y = 40 * (q > 20) + 11 * d + 23 * (c == 2) * (d > 2) + 7 * s * (q % 5 == 0) + r.integers(0, 30, n)
    rows = [(f"r{i:05d}", float(q[i]), float(d[i]), "abcd"[c[i]], None if s[i] == 2 else f"s{s[i]}", float(y[i]))
            for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def _fit(spark, depth, **kw):
    df = _lines(spark)
    return df, ml.fit_sales_model(df, num_trees=TREES, max_depth=depth, max_bins=64, partitions=1, **kw)


@pytest.mark.parametrize("depth", [4, 9])
def test_trees_are_those_of_spark_on_the_same_bootstrap(spark, depth):
    """Each tree, also below the levels found by lookup, equals a Spark ML tree
    that is given the bootstrap counts as weights."""
    df, m = _fit(spark, depth)
    train = df.where(~ml.is_test_row("row_id")).orderBy("row_id").toPandas()
    for t, tree in enumerate(m.pipeline.stages[-1].trees):
        train["w"] = forest.bootstrap(42, t, 0, 0, len(train)).astype(float)
        drawn = spark.createDataFrame(train[train.w > 0].where(train.notna(), None), f"{SCHEMA}, w double")
        encoded = drawn.select("*", *ml.standardized(m.numeric, m.scaling, "__z"))
        for stage in m.pipeline.stages[:-1]:
            encoded = stage.transform(encoded)
        spark_ml = RandomForestRegressor(
            labelCol="sales", numTrees=1, bootstrap=False, weightCol="w", maxDepth=depth, maxBins=64,
            featureSubsetStrategy="all").fit(encoded)
        theirs = spark_ml.trees[0]
        assert tree.numNodes == theirs.numNodes and tree.depth == theirs.depth
        both = theirs.transform(tree.transform(encoded).withColumnRenamed("prediction", "ours"))
        assert both.where(F.abs(F.col("ours") - F.col("prediction")) > 1e-9).count() == 0
        if depth == 4:      # deeper nodes hold few rows, and ties
            assert tree.featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray(), abs=1e-9)


def test_metrics_are_those_of_the_model(spark):
    """Nodes found by lookup predict what the Spark ML model predicts, for a level never trained on, too."""
    df, m = _fit(spark, 8)
    new = spark.createDataFrame([("x", 3.0, 9.0, "never", "s1", 5.0)], SCHEMA)
    theirs = m.predict(df.unionByName(new)).select("row_id", "sales", "prediction")
    test = theirs.where(ml.is_test_row("row_id") & (F.col("row_id") != "x"))
    want, got = ml.regression_metrics(test, "sales", "prediction").first(), m.metrics.first()
    assert got["n"] == want["n"] and list(got)[1:] == pytest.approx(list(want)[1:], rel=1e-9)
    assert theirs.where(F.col("row_id") == "x").first()["prediction"] > 0


def test_passes_over_few_nodes_give_the_same_trees(spark, monkeypatch):
    df, m = _fit(spark, 6)
    monkeypatch.setattr(forest, "TASK_BYTES", 40_000)
    _, small = _fit(spark, 6, node_memory_mb=0)
    assert small.importance.collect() == m.importance.collect()
    assert small.metrics.collect() == m.metrics.collect()


def test_a_row_is_added_once_per_joint_code():
    """16 columns with 81 features share a few codes, and their sums are exact."""
    sizes = [32, 11, 7, 12, 4, 7, 7, 12, 4, 7, 8, 6, 6, 26, 7, 26]
    layout = forest.Layout(sizes, 10)
    assert len(layout.groups) <= 8 and max(layout.cells) <= forest.JOINT_CELLS
    assert sorted(c for g in layout.groups for c in g) == list(range(16))
    assert layout.features == 10 + sum(n - 1 for n in sizes[10:])
    r = np.random.default_rng(1)
    columns = [r.integers(0, n, 500) for n in sizes]
    codes, node = layout.join(columns), r.integers(0, 3, 500)
    sums = []
    for g, cells in enumerate(layout.cells):
        s = np.zeros(4 * cells, complex)
        np.add.at(s, node * cells + codes[g], 1 + 2j)
        sums.append(s)
    table = layout.per_column(sums, 3)
    for c, n in enumerate(sizes):
        assert (layout.values(c)[codes[layout.group_of[c]]] == columns[c]).all()
        for k in range(3):
            want = np.bincount(columns[c][node == k], minlength=n)
            assert (table[k, layout.starts[c]:layout.starts[c + 1]] == want * (1 + 2j)).all()


def test_bootstrap_counts_are_poisson():
    w = forest.bootstrap(42, 3, 1, 0, 400_000)
    assert (w == forest.bootstrap(42, 3, 1, 0, 400_000)).all()
    for other in ((41, 3, 1, 0), (42, 2, 1, 0), (42, 3, 0, 0), (42, 3, 1, 1)):
        assert abs(np.corrcoef(w, forest.bootstrap(*other, 400_000))[0, 1]) < 0.01
    share = np.bincount(w, minlength=6)[:6] / len(w)
    assert share == pytest.approx([np.exp(-1) / k for k in (1, 1, 2, 6, 24, 120)], abs=0.003)
    assert w.max() < 20


def test_thresholds_lie_between_values_or_at_equal_shares():
    assert forest.edges_of([(1.0, 5), (2.0, 1), (4.0, 9)], 3) == [1.5, 3.0]
    assert forest.edges_of([(float(v), 10) for v in range(8)], 4) == [1.5, 3.5, 5.5]
    assert forest.edges_of([(1.0, 5)], 32) == [] and forest.edges_of([], 32) == []


def test_thresholds_of_many_values_are_quantiles(spark, monkeypatch):
    monkeypatch.setattr(forest, "LISTED_VALUES", 50)
    df = spark.range(1000).select((F.col("id") / 10).alias("x"), (F.col("id") % 3).cast("double").alias("y"))
    e = forest.bin_edges(df, ["x", "y"], 4)
    assert e["x"] == pytest.approx([24.975, 49.95, 74.925]) and e["y"] == [0.5, 1.5]


def test_null_label_or_feature_fails(spark):
    df = _lines(spark, 300)
    for c in ("sales", "quantity"):
        bad = df.withColumn(c, F.when(~F.col("row_id").endswith("1"), F.col(c)))
        with pytest.raises(Exception, match="null or NaN"):
            ml.fit_sales_model(bad, num_trees=1, max_depth=2, max_bins=32, partitions=1)
