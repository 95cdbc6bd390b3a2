"""Every registered query against its DuckDB statement (exact values)."""

import pytest

from kpiforge.plans.registry import ORACLE, QUERIES

from sf_paths import SF_CHECK
from oracle_check import compare, duck


@pytest.fixture(scope="module")
def con():
    return duck(SF_CHECK)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], ORACLE[name], SF_CHECK)
    assert r["ok"] and r["rows"] > 0, r


def test_only_fits_have_no_oracle(spark):
    models = set(QUERIES) - set(ORACLE)
    assert models == {
        "sales_model_metrics", "sales_model_importance", "model_comparison", "model_cv_scores",
        "forecast_feature_importance", "sales_forecast", "history_plus_forecast"}


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    rows = df.collect()
    assert len(rows) == 6
    assert df.columns == ["category", "sales", "profit", "quantity", "order_count",
                          "profit_margin"]
    assert set(e.oracle_sql()) <= set(e.queries())
