"""Run registered queries against their SQL in DuckDB and compare the values.

    python tools/check.py [--sf DIR] [NAME_PART ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def normal(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else (float(v) if v != 0 else 0.0)
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        return normal(v.item())
    return v


def rows_of(frame):
    cols = sorted(frame.columns)
    recs = [tuple(normal(v) for v in r) for r in frame[cols].itertuples(index=False, name=None)]
    return cols, sorted(recs, key=repr)


def main():
    import duckdb

    from sentrylens.plans.catalog import CHECKS, QUERIES
    from sentrylens.session import local_session, release_tables

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("parts", nargs="*")
    args = ap.parse_args()
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{args.sf}/{t}.parquet'")
    bad = 0
    for name, fn in QUERIES.items():
        if args.parts and not any(p in name for p in args.parts):
            continue
        t0 = time.time()
        try:
            got = fn(spark, args.sf).toPandas()
        except Exception as e:  # report and go on
            bad += 1
            print(f"ERROR {name}: {str(e)[:600]}")
            continue
        dt = time.time() - t0
        release_tables(spark)
        if name not in CHECKS:
            print(f"rows  {name}: {len(got)} ({dt:.1f}s)")
            continue
        try:
            want = db.execute(CHECKS[name]).df()
        except Exception as e:
            bad += 1
            print(f"SQLERR {name}: {str(e)[:600]}")
            continue
        (gc, gr), (wc, wr) = rows_of(got), rows_of(want)
        types = {c: (str(got[c].dtype), str(want[c].dtype)) for c in gc if c in wc
                 and str(got[c].dtype) != str(want[c].dtype)}
        if gc == wc and gr == wr and not types:
            print(f"ok    {name}: {len(gr)} ({dt:.1f}s)")
        else:
            bad += 1
            print(f"DIFF  {name}: rows {len(gr)}/{len(wr)} cols {gc if gc == wc else (gc, wc)} types {types}")
            extra = [r for r in gr if r not in set(wr)][:3] if len(gr) < 20000 else gr[:2]
            lack = [r for r in wr if r not in set(gr)][:3] if len(gr) < 20000 else wr[:2]
            print("   spark:", extra, "\n   duck: ", lack)
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
