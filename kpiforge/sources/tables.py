"""Parquet star-schema source: the driver tables flattened into order lines.

``sales_fact`` builds one row per line item with the order-line columns of
``SalesSpec``: a literal inner join of all six tables, so every report sees the
same population whatever columns it asks for. A caller that declares the
foreign keys (``trust_keys=True``: every line has its order and part, every
order its customer) gets only the joins its columns need; ``orphan_counts``
verifies that declaration.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import DEFAULT_SPEC, SalesSpec

STAR_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
               "lineitem")

# Broadcast a dimension only when the optimizer's size estimate (taken from
# file sizes, no scan) is below this; larger sides fall back to a shuffle join
# and AQE may still convert at runtime from measured sizes.
BROADCAST_LIMIT_BYTES = 16 * 1024 * 1024


def read_table(spark: SparkSession, sf_dir: str, name: str,
               tables: Mapping[str, str] | None = None) -> DataFrame:
    """A star table from its folder, or from the catalogue if ``tables`` names it."""
    if tables and name in tables:
        return spark.table(tables[name])
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bucket_star(spark: SparkSession, sf_dir: str, out_dir: str, prefix: str, buckets: int) -> dict[str, str]:
    """Orders and line items written once, bucketed and sorted by order key, as
    tables ``{prefix}_orders`` and ``{prefix}_lineitem`` with their files below
    ``out_dir``. Given to ``sales_fact(tables=...)``, line items meet their orders
    without being shuffled: a one-off cost that every later report saves."""
    names = {}
    for table, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        names[table] = f"{prefix}_{table}"
        (read_table(spark, sf_dir, table).repartition(buckets, key).write
         .bucketBy(buckets, key).sortBy(key).mode("overwrite")
         .option("path", f"{out_dir.rstrip('/')}/{names[table]}").saveAsTable(names[table]))
    return names


def file_listing(spark: SparkSession, folder: str,
                 tables: Iterable[str] = STAR_TABLES) -> tuple:
    """(path, length, modification time) of every file of the tables, through
    Hadoop's file system: what a fit over these tables depends on."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{t}.parquet")
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            continue
        files = fs.listFiles(path, True)
        while files.hasNext():
            f = files.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def finite(col: str) -> Column:
    """A double column with NaN and infinities as null (gaps, as in pandas)."""
    c = F.col(col)
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of a plan, or None when unavailable."""
    try:
        size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        return int(size) if isinstance(size, int) else int(size.toString())
    except Exception:  # Spark Connect or a plan without statistics
        return None


def _type_width(t) -> int:
    """Bytes per value as Catalyst's size estimates count them."""
    name = t.typeName()
    if name in ("string", "binary"):
        return 20
    if name == "decimal":
        return 8 if t.precision <= 18 else 16
    return {"boolean": 1, "byte": 1, "short": 2, "integer": 4, "date": 4,
            "float": 4}.get(name, 8)


def _row_width(df: DataFrame) -> int:
    return max(1, sum(_type_width(f.dataType) for f in df.schema.fields))


def sized_broadcast(df: DataFrame, limit: int | None = None,
                    size: int | None = None) -> DataFrame:
    """``broadcast(df)`` if its size (given, or Catalyst's estimate) is under
    ``limit`` (default ``BROADCAST_LIMIT_BYTES``), else df unchanged."""
    limit = BROADCAST_LIMIT_BYTES if limit is None else limit
    size = estimated_bytes(df) if size is None else size
    if size is not None and size <= limit:
        return F.broadcast(df)
    return df


def fk_join_size(many: DataFrame, joined: DataFrame) -> int | None:
    """Size bound of ``many`` joined to a table on that table's primary key:
    at most one output row per row of ``many``, each as wide as ``joined``'s
    row (Catalyst's own estimate of a join is the product of its inputs)."""
    base = estimated_bytes(many)
    if base is None:
        return None
    return base * _row_width(joined) // _row_width(many)


def _fact_columns(spec: SalesSpec) -> dict[str, tuple[Column, set[str]]]:
    """Output column -> (expression, dimension tables it needs)."""
    li = lambda c: F.col(c)  # noqa: E731  (readability of the table below)
    sales = finite("l_extendedprice") * (F.lit(1) - finite("l_discount"))
    return {
        spec.row_id: (F.concat_ws("-", li("l_orderkey"), li("l_partkey"),
                                  li("l_suppkey"), li("l_linenumber")), set()),
        spec.order_id: (li("l_orderkey"), set()),
        spec.order_date: (F.to_date(F.col("o_orderdate")), {"orders"}),
        spec.ship_date: (F.to_date(li("l_shipdate")), set()),
        spec.ship_mode: (F.col("o_orderpriority"), {"orders"}),
        spec.customer_id: (F.col("o_custkey"), {"orders"}),
        spec.customer_name: (F.col("c_name"), {"orders", "customer"}),
        spec.segment: (F.col("c_mktsegment"), {"orders", "customer"}),
        spec.region: (F.col("r_name"), {"orders", "customer", "geo"}),
        spec.state: (F.col("n_name"), {"orders", "customer", "geo"}),
        spec.product_id: (li("l_partkey"), set()),
        spec.product_name: (F.col("p_name"), {"part"}),
        spec.category: (F.col("p_type"), {"part"}),
        spec.sub_category: (F.col("p_brand"), {"part"}),
        spec.quantity: (finite("l_quantity"), set()),
        # + 0.0 turns the -0.0 present in the data into 0.0
        spec.discount: (finite("l_discount") + F.lit(0.0), set()),
        spec.sales: (sales.cast("decimal(18,4)"), set()),
        spec.profit: ((sales - finite("l_quantity") * finite("p_retailprice"))
                      .cast("decimal(18,4)"), {"part"}),
    }


def fact_columns(spec: SalesSpec = DEFAULT_SPEC) -> list[str]:
    """Output column names of ``sales_fact`` in order (no Spark needed)."""
    return [spec.row_id, spec.order_id, spec.order_date, spec.ship_date, spec.ship_mode,
            spec.customer_id, spec.customer_name, spec.segment, spec.region, spec.state,
            spec.product_id, spec.product_name, spec.category, spec.sub_category,
            spec.quantity, spec.discount, spec.sales, spec.profit]


def columns_with_gaps(spark: SparkSession, sf_dir: str, spec: SalesSpec = DEFAULT_SPEC) -> set[str]:
    """Columns of ``sales_fact`` (computed measures aside) that may hold nulls:
    their table does. One scan of each table, no join. Keys that lines are joined
    on and the row id have none."""
    own = {"lineitem": [spec.ship_date], "orders": [spec.order_date, spec.ship_mode],
           "customer": [spec.customer_name, spec.segment], "nation": [spec.state], "region": [spec.region],
           "part": [spec.product_name, spec.category, spec.sub_category]}
    exprs = _fact_columns(spec)
    found = set()
    for table, cols in own.items():
        row = read_table(spark, sf_dir, table).agg(*[F.bool_or(exprs[c][0].isNull()).alias(c) for c in cols]).first()
        found |= {c for c in cols if row[c]}
    return found


def sales_fact(spark: SparkSession, sf_dir: str,
               columns: Iterable[str] | None = None,
               spec: SalesSpec = DEFAULT_SPEC, trust_keys: bool = False,
               tables: Mapping[str, str] | None = None,
               line_files: Sequence[str] | None = None) -> DataFrame:
    """Flat order-line fact from the star schema (lazy).

    ``columns`` limits the output to what a query needs; default is all
    order-line columns in ``SalesSpec`` order. ``trust_keys`` also limits the
    joins (see the module docstring). ``tables``: names of catalogue tables to
    read instead of folders (``bucket_star``). ``line_files`` reads these files
    of line items only, with their path in the column ``_file``.
    """
    exprs = _fact_columns(spec)
    wanted = list(exprs) if columns is None else list(columns)
    unknown = [c for c in wanted if c not in exprs]
    if unknown:
        raise ValueError(f"unknown fact columns: {unknown}")
    needs: set[str] = set()
    for c in wanted:
        needs |= exprs[c][1]
    if not trust_keys:
        needs = {"orders", "customer", "geo", "part"}

    if line_files is None:
        lines = read_table(spark, sf_dir, "lineitem", tables)
    else:
        lines = spark.read.parquet(*line_files).withColumn("_file", F.col("_metadata.file_path"))
    if "orders" in needs:
        orders = read_table(spark, sf_dir, "orders", tables).select(
            "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
        if "customer" in needs:
            cust = read_table(spark, sf_dir, "customer").select(
                "c_custkey", "c_name", "c_mktsegment", "c_nationkey")
            if "geo" in needs:
                nation = read_table(spark, sf_dir, "nation")
                region = read_table(spark, sf_dir, "region")
                geo = (nation.join(sized_broadcast(region),
                                   nation.n_regionkey == region.r_regionkey)
                       .select("n_nationkey", "n_name", "r_name"))
                cust = (cust.join(sized_broadcast(geo),
                                  cust.c_nationkey == geo.n_nationkey)
                        .drop("n_nationkey"))
            # Attach customers to orders before the (larger) line items meet
            # them, so the line items are shuffled by order key only.
            joined = orders.join(sized_broadcast(cust), orders.o_custkey == cust.c_custkey)
            bound = fk_join_size(orders, joined)
            orders = joined
        else:
            bound = None
        lines = lines.join(sized_broadcast(orders, size=bound),
                           lines.l_orderkey == orders.o_orderkey)
    if "part" in needs:
        part = read_table(spark, sf_dir, "part").select(
            "p_partkey", "p_name", "p_type", "p_brand", "p_retailprice")
        lines = lines.join(sized_broadcast(part),
                           lines.l_partkey == part.p_partkey)
    return lines.select(*["_file"] * (line_files is not None), *[exprs[c][0].alias(c) for c in wanted])


def orphan_counts(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """Rows that the inner star join would drop, per foreign key (all zero
    when the join pruning of ``sales_fact`` is exact). A diagnostic: each
    count is an anti join over the full tables."""
    t = {n: read_table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "part",
                                                   "nation", "region")}
    checks = {
        "lineitem.l_orderkey": (t["lineitem"], t["orders"], "l_orderkey", "o_orderkey"),
        "lineitem.l_partkey": (t["lineitem"], t["part"], "l_partkey", "p_partkey"),
        "orders.o_custkey": (t["orders"], t["customer"], "o_custkey", "c_custkey"),
        "customer.c_nationkey": (t["customer"], t["nation"], "c_nationkey", "n_nationkey"),
        "nation.n_regionkey": (t["nation"], t["region"], "n_regionkey", "r_regionkey"),
    }
    return {name: child.join(parent, child[ck] == parent[pk], "left_anti").count()
            for name, (child, parent, ck, pk) in checks.items()}


# SQL text of the same fact for DuckDB oracles (full six-table inner join).
FACT_SQL = """
SELECT
  concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS row_id,
  l_orderkey AS order_id,
  CAST(o_orderdate AS DATE) AS order_date,
  CAST(l_shipdate AS DATE) AS ship_date,
  o_orderpriority AS ship_mode,
  o_custkey AS customer_id,
  c_name AS customer_name,
  c_mktsegment AS segment,
  r_name AS region,
  n_name AS state,
  l_partkey AS product_id,
  p_name AS product_name,
  p_type AS category,
  p_brand AS sub_category,
  l_quantity AS quantity,
  l_discount + 0.0 AS discount,
  CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS sales,
  CAST(l_extendedprice * (1 - l_discount) - l_quantity * p_retailprice
       AS DECIMAL(18,4)) AS profit
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
JOIN part ON l_partkey = p_partkey
"""
