"""Run registered queries in Spark and their SQL in DuckDB and compare.

    python tests/oracle_check.py [sf_dir] [name ...]

Comparison: same column names and types, same row count, and the same
multiset of rows with values compared exactly (doubles bit for bit, NaN == NaN,
None == None).
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (0, "")  # pandas turns SQL NULL into NaN in float columns
        return (1, repr(float(v)))
    if isinstance(v, decimal.Decimal):
        return (1, repr(float(v)))
    if isinstance(v, (dt.datetime, dt.date)):
        return (2, v.isoformat()[:10] if isinstance(v, dt.date) and not isinstance(v, dt.datetime)
                else v.isoformat())
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, bool):
        return (3, str(int(v)))
    if isinstance(v, int):
        return (1, repr(float(v)))
    return (4, str(v))


def _spark_type(t: str) -> str:
    return {"float": "double", "int": "integer"}.get(t, t)


def _duck_type(t) -> str:
    t = str(t).lower()
    return {"varchar": "string", "float": "double"}.get(t, t)


def rows_of(records, cols):
    return sorted(tuple(_norm(r[c]) for c in cols) for r in records)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [r.asDict() for r in sdf.collect()]
    t1 = time.time()
    scols = sorted(sdf.columns)
    if sql is None:
        return {"name": name, "ok": None, "rows": len(srows), "spark_s": round(t1 - t0, 2)}
    rel = con.sql(sql)
    dcols = sorted(rel.columns)
    drows = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
    res = {"name": name, "rows": len(srows), "oracle_rows": len(drows),
           "spark_s": round(t1 - t0, 2), "oracle_s": round(time.time() - t1, 2)}
    if scols != dcols:
        res.update(ok=False, why=f"columns {scols} != {dcols}")
        return res
    stypes = {f.name: _spark_type(f.dataType.simpleString()) for f in sdf.schema.fields}
    dtypes = {c: _duck_type(t) for c, t in zip(rel.columns, rel.types)}
    bad = {c: (stypes[c], dtypes[c]) for c in scols if stypes[c] != dtypes[c]}
    if bad:
        res.update(ok=False, why=f"column types differ: {bad}")
        return res
    a, b = rows_of(srows, scols), rows_of(drows, dcols)
    if len(a) != len(b):
        res.update(ok=False, why="row count")
        return res
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    res["ok"] = not diff
    if diff:
        res["why"] = f"{len(diff)} rows differ, first: {diff[0]}"
    return res


def main(argv):
    sf_dir = "/root/testdata/sf0.01"
    names = []
    for a in argv:
        if a.startswith("/"):
            sf_dir = a
        else:
            names.append(a)
    from kpiforge.session import local_session
    from kpiforge.plans.registry import oracle, queries
    spark = local_session(8)
    con = duck(sf_dir)
    qs, ors = queries(), oracle()
    bad = 0
    for n in (names or list(qs)):
        try:
            r = compare(spark, con, n, qs[n], ors.get(n), sf_dir)
        except Exception as e:  # report and continue
            r = {"name": n, "ok": False, "why": f"{type(e).__name__}: {str(e)[:300]}"}
        bad += r.get("ok") is False
        print(r, flush=True)
    print(f"FAILED {bad}" if bad else "ALL OK")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
