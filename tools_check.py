"""Local correctness check: every registered query vs its DuckDB SQL.

usage: python tools_check.py [sf_dir] [name ...]
"""
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from termlens.plans.queries import REGISTRY  # noqa: E402
from termlens.session import get_spark  # noqa: E402
from termlens.sources.tables import TABLES  # noqa: E402


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) if abs(v) >= 1e-3 else float(f"{v:.9e}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(REGISTRY)
    spark = get_spark("local[8]", shuffle_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad = 0
    for name in names:
        qy = REGISTRY[name]
        t0 = time.time()
        df = qy.run(spark, sf)
        got = df.collect()
        ts = time.time() - t0
        if qy.sql is None:
            print(f"{name:28s} rows={len(got):7d} spark={ts:6.1f}s  (no oracle)")
            continue
        t0 = time.time()
        res = con.execute(qy.sql)
        ocols = [d[0] for d in res.description]
        odata = res.fetchall()
        td = time.time() - t0
        a = rows(df.columns, [tuple(r) for r in got])
        b = rows(ocols, odata)
        ok = sorted(df.columns) == sorted(ocols) and a == b
        bad += not ok
        print(f"{name:28s} rows={len(got):7d}/{len(odata):7d} spark={ts:6.1f}s duck={td:6.1f}s "
              f"{'OK' if ok else 'MISMATCH'}")
        if not ok:
            print("   cols", sorted(df.columns), sorted(ocols))
            sa, sb = set(a), set(b)
            print("   spark-only", list(sa - sb)[:3])
            print("   duck-only ", list(sb - sa)[:3])
    print("mismatches:", bad)


if __name__ == "__main__":
    main()
