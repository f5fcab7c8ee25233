"""Run registered queries on Spark and their oracle SQL on DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Compares row count, column names and an order-insensitive hash of values.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


STRICT = os.environ.get("ORACLE_LOOSE") is None   # exact float compare by default

# DuckDB result type -> Spark simpleString expected on the Spark side.
DUCK_TO_SPARK = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
                 "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "FLOAT": "float",
                 "SMALLINT": "smallint", "DATE": "date"}


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v) if STRICT else repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (bytes, bytearray)):
        return v.hex()
    return repr(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def compare(spark, con, name, fn, sql, sf_dir, verbose=True):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    rel = con.sql(sql)
    d_cols = list(rel.columns)
    d_types = dict(zip(d_cols, (str(t) for t in rel.types)))
    d_rows = rel.fetchall()
    s_types = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    bad_types = {c: (s_types.get(c), d_types[c]) for c in d_cols
                 if DUCK_TO_SPARK.get(d_types[c].split("(")[0], d_types[c]) != s_types.get(c)}
    ok_cols = sorted(s_cols) == sorted(d_cols) and not bad_types
    ok_n = len(s_rows) == len(d_rows)
    hs, ls = digest(s_cols, s_rows)
    hd, ld = digest(d_cols, d_rows)
    ok = ok_cols and ok_n and hs == hd
    if verbose:
        print(f"{'OK  ' if ok else 'FAIL'} {name}: rows {len(s_rows)}/{len(d_rows)} "
              f"cols {'=' if ok_cols else (s_cols, d_cols, bad_types)} hash {'=' if hs == hd else '!='} "
              f"spark {t1 - t0:.1f}s", flush=True)
        if not ok and ok_cols:
            a, b = set(ls), set(ld)
            for x in sorted(a - b)[:3]:
                print("   spark only:", x[:300])
            for x in sorted(b - a)[:3]:
                print("   duck  only:", x[:300])
    return ok


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    import __spark_entry__ as E
    from scrivener.session import get_session
    spark = get_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, os_ = E.queries(), E.oracle_sql()
    bad = []
    for n in names or sorted(qs):
        if n not in os_:
            sdf = qs[n](spark, sf_dir)
            print(f"ROWS {n}: {sdf.count()} (no oracle)")
            continue
        try:
            if not compare(spark, con, n, qs[n], os_[n], sf_dir):
                bad.append(n)
        except Exception as e:  # report and continue
            print(f"ERR  {n}: {type(e).__name__}: {str(e)[:600]}")
            bad.append(n)
    print("failed:", bad)


if __name__ == "__main__":
    main()
