"""Run registered Spark queries against their DuckDB oracle and compare
row count, column names and an order-insensitive hash of the values.

CLI: ``python tests/oracle_harness.py [sf_dir] [name ...]``.
"""

from __future__ import annotations

import datetime as _dt
import decimal
import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{round(v, 6):.6f}"
    if isinstance(v, decimal.Decimal):
        return f"{round(float(v), 6):.6f}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (_dt.datetime, _dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{_norm(k)}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    lines = sorted("\x1f".join(_norm(r[i]) for i in order) for r in rows)
    h = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return cols, lines, h


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
                 "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP"}


def type_mismatches(df, rel):
    st = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    dt = dict(zip(rel.columns, [str(t) for t in rel.types]))
    return [(c, st[c], dt.get(c)) for c in st if SPARK_TO_DUCK.get(st[c], st[c]) != dt.get(c)]


def compare(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as E
    qs, os_ = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    out = {}
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            out[name] = ("SPARK-ERROR", str(e)[:2000])
            if verbose:
                print(name, "SPARK-ERROR", str(e)[:2000])
            continue
        t1 = time.time()
        if name not in os_:
            out[name] = ("rows-only", len(srows))
            if verbose:
                print(f"{name}: rows-only {len(srows)} rows ({t1 - t0:.1f}s)")
            continue
        try:
            r = con.sql(os_[name])
            tbad = type_mismatches(df, r)
            dcols = r.columns
            drows = r.fetchall()
        except Exception as e:  # noqa: BLE001
            out[name] = ("DUCK-ERROR", str(e)[:2000])
            if verbose:
                print(name, "DUCK-ERROR", str(e)[:2000])
            continue
        t2 = time.time()
        sc, sl, sh = canon(scols, srows)
        dc, dl, dh = canon(dcols, drows)
        ok = sc == dc and len(sl) == len(dl) and sh == dh and not tbad
        out[name] = ("OK" if ok else "MISMATCH", len(srows), len(drows))
        if verbose:
            print(f"{name}: {'OK' if ok else 'MISMATCH'} spark={len(srows)} duck={len(drows)} "
                  f"({t1 - t0:.1f}s / {t2 - t1:.1f}s)")
            if not ok:
                if sc != dc:
                    print("   columns", sc, dc)
                if tbad:
                    print("   types", tbad)
                a, b = set(sl), set(dl)
                for x in sorted(a - b)[:5]:
                    print("   spark-only:", x[:400])
                for x in sorted(b - a)[:5]:
                    print("   duck-only: ", x[:400])
    return out


if __name__ == "__main__":
    from nomen.session import get_spark
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", 8)
    res = compare(spark, sf, sys.argv[2:] or None)
    bad = [k for k, v in res.items() if v[0] not in ("OK", "rows-only")]
    print("BAD:", bad)
