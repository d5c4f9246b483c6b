"""Run catalog queries in Spark and their SQL in DuckDB and compare the results. python tests/compare.py SF [query ...]"""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float) and math.isnan(v):
        return None
    return v.isoformat() if hasattr(v, "isoformat") else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(type(x).__name__ == "str"), str(x)) for x in r))


def differences(spark_rows, duck_rows, tol=1e-9):
    close = 0
    for a, b in zip(spark_rows, duck_rows):
        for x, y in zip(a, b):
            if x == y:
                continue
            if isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= tol * max(1.0, abs(x)):
                close += 1
                continue
            return f"{a}\n   != {b}", close
    return None, close


def check(spark, con, sf_dir, name, query, sql) -> str:
    df = query(spark, sf_dir)
    cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    dcols, want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if cols != dcols:
        return f"columns {set(cols) ^ set(dcols)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    problem, close = differences(got, want)
    return problem or (f"ok ({close} inexact)" if close else "ok")


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tillwork.session import build_session

    folder = f"/root/testdata/sf{sys.argv[1]}"
    session = build_session(cores=8, spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="12g")
    con = duck(folder)
    queries, answers = entry.queries(), entry.oracle_sql()
    for name, query in queries.items():
        if (sys.argv[2:] and name not in sys.argv[2:]) or name not in answers:
            continue
        start = time.time()
        try:
            result = check(session, con, folder, name, query, answers[name])
        except Exception as exc:  # report and go on with the next query
            result = f"ERROR {str(exc)[:600]}"
        print(f"{name:24s} {time.time() - start:6.1f}s {result}", flush=True)
