"""Run registered queries against their SQL on the same parquet tables and compare."""
from __future__ import annotations

import math
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/tests", 1)[0])
from veilspan.session import TABLES  # noqa: E402


def norm(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def compare(df, con, sql: str) -> str | None:
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rel.fetchall()
    got = df.collect()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    order = sorted(names)
    gi, wi = [df.columns.index(c) for c in order], [names.index(c) for c in order]
    a = sorted("|".join(norm(r[i]) for i in gi) for r in got)
    b = sorted("|".join(norm(r[i]) for i in wi) for r in want)
    if a == b:
        return None
    sa, sb = set(a), set(b)
    return f"rows {len(a)} vs {len(b)}; spark-only {sorted(sa - sb)[:3]}; sql-only {sorted(sb - sa)[:3]}"


if __name__ == "__main__":
    import __spark_entry__ as E
    from veilspan.session import build_session

    sf = sys.argv[1]
    only = sys.argv[2:]
    spark = build_session()
    con = connect(sf)
    qs, os_ = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and not any(name.startswith(o) for o in only):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in os_:
                msg = compare(df, con, os_[name])
                n = "oracle"
            else:
                msg, n = None, f"rows {len(df.collect())}"
        except Exception as e:  # noqa: BLE001
            msg, n = f"{type(e).__name__}: {str(e)[:600]}", "error"
        bad += msg is not None
        print(f"{'FAIL' if msg else 'ok  '} {name:32s} {n:10s} {time.time() - t:6.1f}s {msg or ''}", flush=True)
    print("failed", bad, "of", len(qs))
