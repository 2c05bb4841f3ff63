"""Run registered queries against their SQL twins in DuckDB and report differences.

Usage: python tools/compare.py [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelwright.plans import ORACLE, QUERIES  # noqa: E402
from panelwright.session import local_session  # noqa: E402

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, float):
        return float("%.15g" % v)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def kinds(row):
    return [type(v).__name__ for v in row]


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    spark = local_session("8")
    con = duckdb.connect()
    for n in NAMES:
        p = f"{sf}/{n}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{p}')")
    bad = 0
    for name, fn in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            cols = sorted(df.columns)
            got = [tuple(norm(v) for v in r) for r in df.select(*cols).collect()]
            t1 = time.time()
            if name not in ORACLE:
                print(f"rows  {name} rows={len(got)} {t1 - t0:.1f}s", flush=True)
                if not got:
                    bad += 1
                continue
            rel = con.execute(ORACLE[name])
            ocols = [d[0] for d in rel.description]
            order = [ocols.index(c) for c in sorted(ocols)]
            want = [tuple(norm(r[i]) for i in order) for r in rel.fetchall()]
            t2 = time.time()
            if sorted(ocols) != cols:
                print(f"COLS  {name}: spark-only {set(cols) - set(ocols)} sql-only {set(ocols) - set(cols)}", flush=True)
                bad += 1
                continue
            key = lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
            g, w = sorted(got, key=key), sorted(want, key=key)
            if g == w and (not g or kinds(g[0]) == kinds(w[0])):
                print(f"ok    {name} rows={len(g)} spark={t1 - t0:.1f}s duck={t2 - t1:.1f}s{'  EMPTY' if not g else ''}", flush=True)
                continue
            bad += 1
            gs, ws = set(g), set(w)
            print(f"DIFF  {name} rows {len(g)} vs {len(w)}; only spark {len(gs - ws)}, only sql {len(ws - gs)}; cols {cols}")
            for r in sorted(gs - ws, key=key)[:3]:
                print("   spark", r)
            for r in sorted(ws - gs, key=key)[:3]:
                print("   sql  ", r)
            if g and w:
                print("   kinds", kinds(g[0]), kinds(w[0]), flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: {type(e).__name__} {str(e)[:900]}", flush=True)
    print(f"done, {bad} bad")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
