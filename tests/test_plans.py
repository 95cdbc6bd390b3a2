"""Physical-plan properties that matter at scale, checked with explain()."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from kpiforge.operators import clean, forecast, kpi
from kpiforge.plans import frames, registry
from kpiforge.sources.tables import STAR_TABLES, sales_fact
from kpiforge.spec import DEFAULT_SPEC as S

from sf_paths import SF_SMALL


def plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_category_report_joins_only_parts(spark):
    df = kpi.category_performance(sales_fact(spark, SF_SMALL, ["category", "sales", "profit",
                                                               "quantity", "order_id"],
                                             trust_keys=True))
    p = plan(df)
    assert "part.parquet" in p and "orders.parquet" not in p and "customer.parquet" not in p


def test_scan_reads_only_needed_columns(spark):
    p = plan(registry.QUERIES["dash_category_profit"](spark, SF_SMALL))
    li = [line for line in p.splitlines() if line.startswith("ReadSchema") and "l_orderkey" in line
          or (line.startswith("ReadSchema") and "l_partkey" in line)]
    assert li, p
    for line in li:
        assert "l_shipdate" not in line and "l_tax" not in line and "l_returnflag" not in line


def test_distinct_count_is_two_level_aggregate(spark):
    p = plan(registry.QUERIES["segment_performance"](spark, SF_SMALL))
    # partial aggregation keyed by (group, id) before any exchange: no group
    # ever collects its ids in one task
    assert "Expand" in p and p.count("HashAggregate") >= 4


def test_dimension_broadcast_is_size_checked(spark):
    from kpiforge.sources.tables import estimated_bytes, read_table, sized_broadcast
    part = read_table(spark, SF_SMALL, "part")
    assert estimated_bytes(part) is not None
    assert "broadcast" in plan(sized_broadcast(part, limit=10 ** 9).join(part, "p_partkey")).lower()
    # over the limit: no hint, the planner decides from sizes (sort-merge at scale)
    hinted = sized_broadcast(part, limit=1)
    assert hinted is part


def test_monthly_windows_run_after_aggregation(spark):
    p = plan(registry.QUERIES["monthly_features"](spark, SF_SMALL))
    tree = p.split("\n\n")[0].split("\n", 1)[1]      # the operator tree, root first
    ops = [line.strip(" :+-|") for line in tree.splitlines()]
    windows = [i for i, o in enumerate(ops) if o.startswith("Window")]
    aggs = [i for i, o in enumerate(ops) if o.startswith("HashAggregate")]
    # every window sits above (is computed after) the order-line aggregate
    assert windows and aggs and max(windows) < min(aggs), tree


def test_filters_pushed_to_scan(spark):
    from pyspark.sql import functions as F
    df = sales_fact(spark, SF_SMALL, ["ship_date", "sales"]).where(
        F.col("ship_date") >= F.lit("2000-01-01").cast("date"))
    p = plan(df)
    assert "PushedFilters" in p and "l_shipdate" in p.split("PushedFilters")[1].split("\n")[0]


def test_join_pruning_is_exact_on_driver_tables(spark):
    from kpiforge.sources.tables import orphan_counts
    assert set(orphan_counts(spark, SF_SMALL).values()) == {0}
    cols = ["category", "sales", "profit", "quantity", "order_id"]
    pruned = kpi.category_performance(sales_fact(spark, SF_SMALL, cols, trust_keys=True)).collect()
    full = kpi.category_performance(sales_fact(spark, SF_SMALL, cols)).collect()
    assert pruned == full


def test_line_items_are_never_the_broadcast_side(spark):
    """Orders with their customers are broadcast only under a size bound
    derived from the orders table (a foreign-key join adds no rows), and the
    line items always stream."""
    from kpiforge.sources.tables import estimated_bytes, fk_join_size, read_table
    orders = read_table(spark, SF_SMALL, "orders")
    cust = read_table(spark, SF_SMALL, "customer")
    joined = orders.join(cust, orders.o_custkey == cust.c_custkey)
    assert fk_join_size(orders, joined) >= estimated_bytes(orders)
    df = registry.QUERIES["segment_performance"](spark, SF_SMALL)
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = []
            for inner in lines[i + 1:]:
                if depth(inner) <= depth(line):
                    break
                below.append(inner)
            assert not any("l_orderkey" in x and "FileScan" in x for x in below), below


def _shuffled(spark, name):
    """Physical plan of a query with nothing broadcast."""
    import kpiforge.sources.tables as T
    limit = T.BROADCAST_LIMIT_BYTES
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    T.BROADCAST_LIMIT_BYTES = -1
    try:
        return plan(registry.QUERIES[name](spark, SF_SMALL))
    finally:
        T.BROADCAST_LIMIT_BYTES = limit
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))


@pytest.mark.parametrize("name", ["segment_performance", "category_hierarchy"])
def test_lines_are_aggregated_before_they_are_expanded(spark, name):
    tree = _shuffled(spark, name).split("\n\n(")[0].splitlines()
    expand = [i for i, line in enumerate(tree) if "Expand" in line]
    aggregates = [i for i, line in enumerate(tree) if "HashAggregate" in line]
    joins = [i for i, line in enumerate(tree) if "SortMergeJoin" in line]
    assert expand and max(expand) < max(aggregates) < min(joins), tree


def test_order_values_exchange_between_join_and_order_totals(spark):
    """A hot order is spread by the salt; the exchange above the order join
    lets adaptive execution split that join."""
    tree = _shuffled(spark, "dash_segment_aov").split("\n\n(")[0].splitlines()
    join = min(i for i, line in enumerate(tree) if "SortMergeJoin" in line)
    last = max(i for i, line in enumerate(tree[:join]) if "Exchange" in line)
    assert "HashAggregate" in "".join(tree[last:join])


@pytest.fixture
def orphan_folder(spark, tmp_path):
    """The small tables with a third of the orders missing."""
    from kpiforge.sources.tables import STAR_TABLES
    for t in STAR_TABLES:
        df = spark.read.parquet(f"{SF_SMALL}/{t}.parquet")
        if t == "orders":
            df = df.where("o_orderkey % 3 <> 0")
        df.write.parquet(str(tmp_path / f"{t}.parquet"))
    return str(tmp_path)


def test_reports_agree_with_orphan_lines(spark, orphan_folder):
    """One population, whatever columns a report asks for."""
    from kpiforge.sources.tables import orphan_counts
    assert orphan_counts(spark, orphan_folder)["lineitem.l_orderkey"] > 0
    total = lambda name, column: round(sum(
        r[column] for r in registry.QUERIES[name](spark, orphan_folder).collect()), 4)
    sales = {total(n, "sales") for n in ("category_performance", "segment_performance",
                                         "monthly_sales", "shipping_performance")}
    assert len(sales) == 1
    assert {sales_fact(spark, orphan_folder, c).count() for c in (
        None, ["quantity"], ["category"], ["segment", "sales"])} == {
            sales_fact(spark, orphan_folder).count()}


def test_changed_files_are_fitted_again(spark, orphan_folder):
    before = {r["column"]: r["upper_bound"] for r in
              registry.QUERIES["iqr_bounds"](spark, orphan_folder).collect()}
    capped = lambda: registry.QUERIES["prepared_totals"](spark, orphan_folder).collect()
    first = capped()
    path = f"{orphan_folder}/lineitem.parquet"
    lines = spark.createDataFrame(spark.read.parquet(path).toPandas())
    lines.withColumn("l_quantity", lines.l_quantity * 1000).write.mode("overwrite").parquet(path)
    spark.catalog.clearCache()
    after = {r["column"]: r["upper_bound"] for r in
             registry.QUERIES["iqr_bounds"](spark, orphan_folder).collect()}
    assert after["quantity"] == 1000 * before["quantity"]
    assert capped() != first


def test_category_steps_come_from_boosted_fits(spark, monkeypatch):
    """The steps are those of gradient boosting per category, not of another model."""
    asked = []

    def fits(features, future, key, models=("gradient_boosting",), **limits):
        asked.append(tuple(models))
        made = forecast.linear_fits(features, future, [key], **limits)
        return made.withColumn("model", F.lit(models[0]))

    monkeypatch.setattr(registry.forecast, "panel_fits", fits)
    kept = spark.__dict__.setdefault("_kpiforge_fits", {})
    before = dict(kept)
    try:
        for k in [k for k in kept if k[0] == "category_boosted"]:
            del kept[k]
        rows = registry.QUERIES["category_forecast_steps"](spark, SF_SMALL).collect()
    finally:
        kept.clear()
        kept.update(before)
    assert asked == [("gradient_boosting",)]
    assert rows and {r["model"] for r in rows} == {"gradient_boosting"}


def test_the_cleaning_fit_writes_only_what_it_reads(spark):
    """Complete columns are told by their tables: no names, dates or ids are joined and written."""
    st = frames.fit_cleaning(spark, SF_SMALL)
    assert set(spark.read.parquet(st.lines).columns) == set(S.capped)
    assert not any(st.null_counts.values()) and {"row_id", "customer_name", "ship_lag"} <= set(st.null_counts)
    assert not st.medians and not st.modes


def test_the_cleaning_fit_fills_gaps_as_over_all_columns(spark, tmp_path):
    """Nulls in dimension and line columns: the same statistics as from the whole fact."""
    odd = {"customer": ("c_mktsegment", "c_custkey"), "orders": ("o_orderdate", "o_orderkey"),
           "lineitem": ("l_quantity", "l_partkey"), "part": ("p_name", "p_partkey")}
    for t in STAR_TABLES:
        df = spark.read.parquet(f"{SF_SMALL}/{t}.parquet")
        if t in odd:
            col, key = odd[t]
            df = df.withColumn(col, F.when(F.col(key) % 5 != 0, F.col(col)))
        df.write.parquet(f"{tmp_path}/{t}.parquet")
    got = frames.fit_cleaning(spark, str(tmp_path))
    full = clean.with_date_features(sales_fact(spark, str(tmp_path)), S, "strict", "all").cache()
    want = clean.CleaningStats()
    want.bounds = clean.iqr_bounds(clean.impute(full, S, want), list(S.capped))
    assert got.null_counts == want.null_counts and got.null_counts["order_year"] > 0
    assert (got.medians, got.modes, got.bounds) == (want.medians, want.modes, want.bounds)


@pytest.mark.parametrize("name", ["iqr_capped_totals", "iqr_bounds_by_file"])
def test_bounds_reports_reread_the_fitted_lines(spark, name, monkeypatch):
    """Exact passes scan the lines that the fit wrote; the star is not joined for each."""
    joins = []
    monkeypatch.setattr(registry, "raw_fact", lambda *a, **k: joins.append(a))
    assert len(registry.QUERIES[name](spark, SF_SMALL).collect()) == 4 and not joins


def test_order_values_keep_one_row_for_an_order(spark):
    """No task's table holds more groups than orders: lines are not told apart by a salt."""
    p = plan(registry.QUERIES["dash_segment_aov"](spark, SF_SMALL))
    assert "xxhash64(sales" not in p and "_salt" not in p


@pytest.mark.parametrize("name", ["category_performance", "subcategory_performance"])
def test_order_groups_are_dealt_by_the_size_of_the_lines(spark, name, monkeypatch):
    monkeypatch.setattr(frames, "LINE_BYTES", 1 << 10)
    parts = frames.line_partitions(spark, SF_SMALL)
    assert parts > 50 and f", {parts}), REPARTITION_BY_NUM" in plan(registry.QUERIES[name](spark, SF_SMALL))
