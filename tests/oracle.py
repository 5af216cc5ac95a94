"""Run registered queries and their SQL twins and compare the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, int):
        return repr(float(v))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def compare(spark, con, fn, sql: str, sf_dir: str) -> tuple[str, int]:
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    left = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns differ: spark {cols} sql {sorted(names)}", len(left)
    order = [names.index(c) for c in cols]
    right = sorted(tuple(_norm(r[i]) for i in order) for r in cur.fetchall())
    if left == right:
        return "", len(left)
    in_left, in_right = set(left), set(right)
    only_l = [r for r in left if r not in in_right][:2]
    only_r = [r for r in right if r not in in_left][:2]
    return f"rows {len(left)} vs {len(right)}\n   cols {cols}\n   spark {str(only_l)[:1500]}\n   sql   {str(only_r)[:1500]}", len(left)


def main(argv: list[str]) -> None:
    sf_dir = argv[0]
    import __spark_entry__ as entry
    from siteprism.common import session

    spark = session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    qs, os_ = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if len(argv) > 1 and not any(name.startswith(p) for p in argv[1:]):
            continue
        t0 = time.time()
        try:
            if name in os_:
                msg, n = compare(spark, con, fn, os_[name], sf_dir)
            else:
                msg, n = "", len(fn(spark, sf_dir).collect())
        except Exception as e:  # report and go on
            msg, n = f"{type(e).__name__}: {str(e)[:1200]}", -1
        bad += bool(msg)
        print(f"{'FAIL' if msg else 'ok  '} {name} rows={n} {time.time() - t0:.2f}s {'' if name in os_ else '(rows only)'} {msg}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
