"""Command line: run the pipeline or single registered queries.

    python -m kpiforge run --source /path/to/tables --out /path/to/out [--kind csv]
    python -m kpiforge query category_performance --source /path/to/tables
    python -m kpiforge list
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="kpiforge")
    sub = ap.add_subparsers(dest="cmd", required=True)
    run = sub.add_parser("run", help="end-to-end pipeline")
    run.add_argument("--source", required=True)
    run.add_argument("--out", required=True)
    run.add_argument("--kind", default="star", choices=["star", "csv", "parquet"])
    run.add_argument("--stages", nargs="*")
    run.add_argument("--format", default="parquet", choices=["parquet", "json", "csv"])
    run.add_argument("--horizon", type=int, default=6)
    q = sub.add_parser("query", help="show one registered query")
    q.add_argument("name")
    q.add_argument("--source", required=True)
    q.add_argument("--rows", type=int, default=50)
    sub.add_parser("list", help="list registered queries")
    args = ap.parse_args(argv)

    from .plans.registry import ORACLE, QUERIES
    if args.cmd == "list":
        for n in QUERIES:
            print(n, "(oracle)" if n in ORACLE else "(rows-only)")
        return 0

    from pyspark.sql import SparkSession

    from .session import DEFAULT_CONF, checkpoint_dir
    builder = SparkSession.builder.appName("kpiforge")
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    checkpoint_dir(spark)
    if args.cmd == "query":
        QUERIES[args.name](spark, args.source).show(args.rows, truncate=False)
        return 0
    from .plans.pipeline import STAGES, run_pipeline
    status, catalog = run_pipeline(spark, args.source, args.out, kind=args.kind,
                                   stages=args.stages or STAGES, horizon=args.horizon,
                                   fmt=args.format)
    status.show(truncate=False)
    catalog.show(100, truncate=False)
    return 0 if all(r["ok"] for r in status.collect()) else 1


if __name__ == "__main__":
    sys.exit(main())
