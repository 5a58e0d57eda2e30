"""Run registered queries in Spark and their oracle SQL in DuckDB; compare."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def compare(spark, name, fn, sql, sf_dir, con):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(_norm(v) for v in r) for r in sdf.collect()]
    t1 = time.time()
    if sql is None:
        return dict(name=name, ok=None, rows=len(s_rows), spark_s=round(t1 - t0, 2))
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = [tuple(_norm(v) for v in r) for r in res.fetchall()]
    out = dict(name=name, rows=len(s_rows), oracle_rows=len(d_rows), spark_s=round(t1 - t0, 2))
    if sorted(s_cols) != sorted(d_cols):
        out.update(ok=False, why=f"columns {s_cols} vs {d_cols}")
        return out
    order = [d_cols.index(c) for c in s_cols]
    d_rows = [tuple(r[i] for i in order) for r in d_rows]
    s_sorted, d_sorted = sorted(s_rows, key=_key), sorted(d_rows, key=_key)
    bad = [(a, b) for a, b in zip(s_sorted, d_sorted) if a != b]
    if len(s_rows) != len(d_rows) or bad:
        out.update(ok=False, why=f"{len(bad)} differing rows; first: {bad[:2]}")
    else:
        out.update(ok=True)
    return out


def main(argv):
    sys.path.insert(0, ".")
    from __spark_entry__ import oracle_sql, queries
    from glosa.session import get_spark
    sf_dir = "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("/")]
    for a in argv:
        if a.startswith("/"):
            sf_dir = a
    spark = get_spark("local[8]", 8)
    con = duck(sf_dir)
    qs, os_ = queries(), oracle_sql()
    fails = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        try:
            r = compare(spark, name, fn, os_.get(name), sf_dir, con)
        except Exception as e:  # noqa: BLE001
            r = dict(name=name, ok=False, why=f"{type(e).__name__}: {str(e)[:300]}")
        fails += r.get("ok") is False
        print(r, flush=True)
    print("FAILS", fails)


if __name__ == "__main__":
    main(sys.argv[1:])
