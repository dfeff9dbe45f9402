"""Spark-vs-DuckDB parity check for the registered queries (like the driver's).

Usage: python tests/parity.py [sf_dir] [key ...]
Compares row count, column names and an order-insensitive hash of values.
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(float(v))
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "item"):
        return _norm(v.item())
    return str(v)


def _digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


SPARK_TO_DUCK = {
    "LongType": "BIGINT", "IntegerType": "INTEGER", "DoubleType": "DOUBLE", "StringType": "VARCHAR",
    "BooleanType": "BOOLEAN", "DateType": "DATE", "TimestampNTZType": "TIMESTAMP", "ShortType": "SMALLINT",
    "FloatType": "FLOAT", "TimestampType": "TIMESTAMP WITH TIME ZONE",
}


def type_mismatches(sdf, cur):
    """Columns whose Spark type does not map to the DuckDB result type."""
    duck_types = {d[0]: str(d[1]) for d in cur.description}
    out = []
    for f in sdf.schema.fields:
        want = SPARK_TO_DUCK.get(type(f.dataType).__name__, type(f.dataType).__name__)
        got = duck_types.get(f.name)
        if got is not None and want != got:
            out.append((f.name, want, got))
    return out


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def check(spark, sf_dir, keys=None, verbose=True):
    import __spark_entry__ as E

    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for k in keys or list(qs):
        t0 = time.time()
        try:
            df = qs[k](spark, sf_dir)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            results[k] = ("SPARK_ERROR", str(e)[:400])
            print(k, "SPARK_ERROR", str(e)[:400], flush=True)
            continue
        st = time.time() - t0
        if k not in sqls:
            results[k] = ("NO_ORACLE", len(srows))
            print(f"{k:32s} rows={len(srows):6d} no-oracle {st:.1f}s", flush=True)
            continue
        try:
            cur = con.execute(sqls[k])
            drows = cur.fetchall()
            dcols = [d[0] for d in cur.description]
        except Exception as e:  # noqa: BLE001
            results[k] = ("DUCK_ERROR", str(e)[:400])
            print(k, "DUCK_ERROR", str(e)[:600], flush=True)
            continue
        hs, ls = _digest(srows, scols)
        hd, ld = _digest(drows, dcols)
        ok_cols = sorted(scols) == sorted(dcols)
        status = "OK" if (ok_cols and hs == hd and len(srows) == len(drows)) else "MISMATCH"
        types = type_mismatches(df, cur)
        results[k] = (status, len(srows), len(drows))
        print(f"{k:32s} {status:8s} spark={len(srows):6d} duck={len(drows):6d} cols_ok={ok_cols} {st:.1f}s"
              + (f" types={types}" if types else ""), flush=True)
        if status != "OK" and verbose:
            if not ok_cols:
                print("   spark cols", sorted(scols), "\n   duck cols ", sorted(dcols))
            a, b = set(ls), set(ld)
            for x in sorted(a - b)[:4]:
                print("   spark-only", x[:300])
            for x in sorted(b - a)[:4]:
                print("   duck-only ", x[:300])
    return results


if __name__ == "__main__":
    from fleetlens.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or None
    spark = local_session()
    res = check(spark, sf, keys)
    bad = [k for k, v in res.items() if v[0] not in ("OK", "NO_ORACLE")]
    print("FAILED:", bad)
