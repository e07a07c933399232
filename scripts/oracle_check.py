"""Run named queries in Spark and their oracle SQL in DuckDB; compare like the driver.

usage: python scripts/oracle_check.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from tessera.plans.registry import load_all  # noqa: E402
from tessera.sources.fixtures import RAW_TABLES, with_fixtures  # noqa: E402
from tessera.session import get_spark  # noqa: E402


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return v


def rows_of(names, tuples):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(norm(t[i]) for i in order) for t in tuples]
    return sorted(out, key=repr)


def main() -> int:
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf_dir, args = args[0], args[1:]
    reg = load_all()
    names = [n for n in reg if not args or any(n.startswith(a) for a in args)]
    if os.environ.get("ORACLE_ONLY"):
        names = [n for n in names if reg[n].oracle]
    spark = get_spark()
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in RAW_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    bad = 0
    for n in names:
        q = reg[n]
        t0 = time.time()
        try:
            sdf = q.build(spark, sf_dir)
            s_cols = sdf.columns
            s_rows = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {n}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if not q.oracle:
            print(f"ok?  {n}: rows={len(s_rows)} (no oracle) {ts:.1f}s")
            continue
        t0 = time.time()
        try:
            res = con.execute(with_fixtures(q.oracle))
            d_cols = [d[0] for d in res.description]
            d_rows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {n}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        td = time.time() - t0
        if sorted(s_cols) != sorted(d_cols):
            print(f"FAIL {n}: columns spark={s_cols} duck={d_cols}")
            bad += 1
            continue
        a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
        if len(a) != len(b):
            print(f"FAIL {n}: rows spark={len(a)} duck={len(b)}")
            bad += 1
            sa, sb = set(a), set(b)
            print("   spark-only:", list(sa - sb)[:3])
            print("   duck-only: ", list(sb - sa)[:3])
            continue
        diff = [(x, y) for x, y in zip(a, b) if x != y]
        if diff:
            print(f"FAIL {n}: {len(diff)} differing rows of {len(a)}; cols={sorted(s_cols)}")
            for x, y in diff[:3]:
                print("   spark:", x)
                print("   duck: ", y)
            bad += 1
            continue
        print(f"ok   {n}: rows={len(a)} spark {ts:.1f}s duck {td:.1f}s")
    print(f"{len(names) - bad}/{len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
