"""Kept partial aggregates, heavy hitters, bucketed star tables and the
splittable CSV reader against plain recomputation."""

import collections
import datetime as dt
import os
import random
import shutil

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kpiforge.operators import kpi, partials, series, stats
from kpiforge.plans.frames import line_partials
from kpiforge.sources import csv as sales_csv
from kpiforge.sources.tables import bucket_star, fact_columns, file_listing, sales_fact
from sf_paths import SF_SMALL

COLUMNS = ["order_date", "category", "segment", "sales", "profit", "quantity", "discount", "order_id", "customer_id"]


@pytest.fixture
def star(spark, tmp_path):
    """The small star with its line items in six files."""
    folder = str(tmp_path / "star")
    os.mkdir(folder)
    for n in os.listdir(SF_SMALL):  # contents alone: the tables may be read-only
        if n != "lineitem.parquet":
            shutil.copyfile(f"{SF_SMALL}/{n}", f"{folder}/{n}")
    lines = pq.read_table(f"{SF_SMALL}/lineitem.parquet")
    os.mkdir(f"{folder}/lineitem.parquet")
    step = -(-lines.num_rows // 6)
    for k in range(6):
        pq.write_table(lines.slice(k * step, step), f"{folder}/lineitem.parquet/part-{k}.parquet")
    return folder


def _rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def _months(spark, star):
    kept, read = line_partials(spark, star, "months", COLUMNS, lambda df: partials.monthly_partials(df, ["category"]))
    return series.public(partials.merged_months(kept, ["category"])), read


def test_only_changed_files_are_read(spark, star):
    plain = lambda: _rows(series.public(series.monthly_series(sales_fact(spark, star), ["category"])))
    files = [f[0] for f in file_listing(spark, star, ["lineitem"])]
    got, read = _months(spark, star)
    assert sorted(read) == files and _rows(got) == plain()
    got, read = _months(spark, star)
    assert read == [] and _rows(got) == plain()
    # one file changes, one comes
    local = [f.removeprefix("file:") for f in files]
    pq.write_table(pq.read_table(local[0]).slice(0, 500), local[0])
    pq.write_table(pq.read_table(local[1]).slice(0, 10), local[1].replace("part-", "part-new-"))
    spark.catalog.refreshByPath(star)
    got, read = _months(spark, star)
    assert len(read) == 2 and files[0] in read and _rows(got) == plain()


def test_unmarked_rows_are_not_merged(spark, tmp_path):
    """A run that died after its rows and before its mark is made again."""
    store = partials.FilePartials(spark, str(tmp_path))
    read = lambda paths: spark.createDataFrame([(p, 1) for p in paths], "_file string, n int")
    read(["a"]).write.parquet(f"{tmp_path}/rows/run=dead")
    got, _ = store.refresh([("a", 1, 1), ("b", 1, 1)], read, lambda df: df)
    assert got.count() == 2
    got, done = store.refresh([("a", 1, 2)], read, lambda df: df, depends_on="x")
    assert got.count() == 1 and done == ["a"]


def test_sketched_brackets_give_exact_quartiles_in_fewer_scans(spark, star):
    cols = ["sales", "quantity", "discount"]
    kept, _ = line_partials(spark, star, "q", fact_columns(), lambda df: partials.quantile_partials(df, cols))
    targets = {c: (0.25, 0.5, 0.75) for c in cols}
    ranks = partials.sketched_ranks(kept, targets)
    lines = sales_fact(spark, star, cols).cache()
    assert ranks["sales"][0] == lines.count()
    scans = []

    class Counted:
        """Counts the passes over the lines."""
        schema, columns = lines.schema, lines.columns

        def __getattr__(self, name):
            scans.append(name)
            return getattr(lines, name)

    plain = stats.exact_quantiles(Counted(), targets)
    first = len([s for s in scans if s in ("agg", "where")])
    scans.clear()
    assert stats.exact_quantiles(Counted(), targets, brackets=ranks) == plain
    assert len([s for s in scans if s in ("agg", "where")]) < first
    # wrong brackets cost passes, never the result
    wrong = {c: (n, [1.0] * len(v)) for c, (n, v) in ranks.items()}
    assert stats.exact_quantiles(lines, targets, brackets=wrong) == plain
    # an empty column
    none = spark.createDataFrame([("f", None)], "_file string, x double")
    ranks = partials.sketched_ranks(partials.quantile_partials(none, ["x"]), {"x": (0.5,)})
    assert stats.exact_quantiles(none, {"x": (0.5,)}, brackets=ranks) == {"x": {0.5: None}}


def test_distinct_sketches_roll_up_within_their_bound(spark):
    rows = spark.range(400_000).select(
        (F.col("id") % 4).cast("string").alias("g"), (F.col("id") * 7919 % 150_000).alias("who"),
        F.date_add(F.lit(dt.date(2020, 1, 1)), (F.col("id") % 700).cast("int")).alias("d"))
    kept = partials.distinct_partials(rows, ["g"], ["who"], "d", lg=12)
    exact = {r["g"]: r["n"] for r in rows.groupBy("g").agg(F.count_distinct("who").alias("n")).collect()}
    got = {r["g"]: r["who"] for r in partials.distinct_rollup(kept, ["g"], ["who"], lg=12).collect()}
    assert got.keys() == exact.keys()
    for g, n in exact.items():          # four deviations of 1 / sqrt(4096)
        assert abs(got[g] - n) <= 4 * n / 64
    few = rows.where("who < 50")
    rolled = partials.distinct_rollup(partials.distinct_partials(few, ["g"], ["who"], "d"), [], ["who"])
    assert rolled.first()["who"] == 50


@pytest.mark.parametrize("counters", [1, 5, 50, 4096])
def test_modes_of_many_values(spark, counters):
    """Equal to plain counting, ties included, with and without enough counters."""
    rnd = random.Random(counters)
    rows = [(f"id{rnd.randrange(3000)}" if rnd.random() < 0.7 else "hot", rnd.randrange(2000),
             "b" if k % 2 else "a", None if k % 3 else f"u{k}", rnd.choice(["x", "y", None])) for k in range(4000)]
    df = spark.createDataFrame(rows, "many string, flat long, tie string, single string, few string").repartition(5)
    want = {}
    for i, c in enumerate(df.columns):
        n = collections.Counter(r[i] for r in rows if r[i] is not None)
        want[c] = min(n, key=lambda v: (-n[v], v))
    assert stats.column_modes(df, df.columns, counters) == want
    assert stats.column_modes(df.limit(0), ["many", "flat"], counters) == {"many": None, "flat": None}


def test_counters_are_bounded_and_honest():
    rnd = random.Random(1)
    held, off, true = {}, 0, collections.Counter()
    for _ in range(50):
        some = collections.Counter(int(rnd.paretovariate(0.7)) for _ in range(400))
        true += some
        off += stats.merge_counters(held, some.items(), 20)
        assert len(held) <= 20
    assert all(true[v] - off <= held.get(v, 0) <= true[v] for v in true)
    assert off <= sum(true.values()) / 21


def test_bucketed_lines_meet_orders_without_a_shuffle(spark, tmp_path):
    names = bucket_star(spark, SF_SMALL, str(tmp_path), "bucket_test", 8)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        from kpiforge.sources import tables
        before, tables.BROADCAST_LIMIT_BYTES = tables.BROADCAST_LIMIT_BYTES, -1
        cols = ["segment", "sales", "order_id", "customer_id"]
        lines = sales_fact(spark, SF_SMALL, cols, trust_keys=True, tables=names)
        plain = sales_fact(spark, SF_SMALL, cols, trust_keys=True)
        count = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(l_orderkey")
        assert count(plain) == 1 and count(lines) == 0
    finally:
        tables.BROADCAST_LIMIT_BYTES = before
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    full = ["segment", "sales", "profit", "order_id", "customer_id"]
    a = kpi.segment_performance(sales_fact(spark, SF_SMALL, full, tables=names))
    assert _rows(a) == _rows(kpi.segment_performance(sales_fact(spark, SF_SMALL, full)))
    for n in names.values():
        spark.sql(f"DROP TABLE {n}")


def _csv_folder(tmp_path, encoding, newline):
    rnd = random.Random(7)

    def field():
        if rnd.random() < 0.4:
            return '"' + "".join(rnd.choice(["a", "é", newline, ",", '""', " ", newline * 2])
                                 for _ in range(rnd.randint(0, 25))) + '"'
        return rnd.choice(["x", "1.5", "", "plain text", "NA"])

    for f in range(2):
        with open(tmp_path / f"f{f}.csv", "w", newline="", encoding=encoding) as h:
            h.write(f"Row ID,Note,Other{newline}")
            for i in range(1500):
                h.write(f"{f}-{i},{field()},{field()}{newline}")
            h.write(f'{f}-last,"long{newline * 3000}field",end')   # a field over many splits, no last newline
    return str(tmp_path)


@pytest.mark.parametrize("encoding,newline", [("utf-8", "\n"), ("utf-8", "\r\n"), ("latin-1", "\n")])
def test_quoted_newlines_in_many_splits(spark, tmp_path, encoding, newline):
    folder = _csv_folder(tmp_path, encoding, newline)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = sales_csv.read_sales_csv(spark, folder, multi_line=True, infer_types=False)
        assert spark.read.text(folder).rdd.getNumPartitions() > 10
        have = collections.Counter(tuple(r) for r in got.collect())
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    plain = (spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
             .option("encoding", "UTF-8" if encoding == "utf-8" else "ISO-8859-1").csv(folder))
    na = set(sales_csv.NA_TOKENS)
    clean = lambda x: None if x is None or x.strip(" ") in na else x.replace("\r\n", "\n")
    want = collections.Counter(tuple(map(clean, r)) for r in plain.collect())
    assert collections.Counter({tuple(map(clean, k)): n for k, n in have.items()}) == want
    assert sum(have.values()) == 3002
