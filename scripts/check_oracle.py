"""Run registered queries in Spark and their SQL oracle in DuckDB; compare.

Usage: python scripts/check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

sys.path.insert(0, __file__.rsplit("/scripts/", 1)[0])

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return round(v, 6)
    if hasattr(v, "item"):
        return norm(v.item())
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    return v


def rows(df: pd.DataFrame):
    cols = sorted(df.columns)
    out = []
    for rec in df[cols].itertuples(index=False):
        out.append(tuple(norm(None if (not isinstance(x, (list, dict)) and pd.isna(x)) else x) for x in rec))
    return cols, sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def main():
    from repsight.plans import ORACLE, QUERIES
    from repsight.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            sdf = QUERIES[name](spark, sf_dir)
            sp = sdf.toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"{name:28s} SPARK ERROR {str(e)[:400]}")
            bad += 1
            continue
        t1 = time.time()
        if name not in ORACLE:
            print(f"{name:28s} rows={len(sp)} (no oracle) spark={t1-t0:.1f}s")
            continue
        try:
            dk = con.sql(ORACLE[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"{name:28s} DUCKDB ERROR {str(e)[:400]}")
            bad += 1
            continue
        c1, r1 = rows(sp)
        c2, r2 = rows(dk)
        ok = c1 == c2 and r1 == r2
        msg = "OK " if ok else "MISMATCH"
        print(f"{name:28s} {msg} rows={len(r1)}/{len(r2)} spark={t1-t0:.1f}s")
        if not ok:
            bad += 1
            if c1 != c2:
                print("   cols spark:", c1, "\n   cols duck: ", c2)
            else:
                s1, s2 = set(r1), set(r2)
                print("   only spark:", list(s1 - s2)[:3])
                print("   only duck: ", list(s2 - s1)[:3])
    print("bad", bad)
    spark.stop()


if __name__ == "__main__":
    main()
