"""python tools_compare.py SF_DIR NAME...: run queries beside their SQL twins and compare rows (as the driver does)."""

import sys
import time

import duckdb
import pandas as pd

import __spark_entry__ as e
from tempolex.session import local_session


def canon(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    rows = []
    for r in df.itertuples(index=False):
        rows.append(tuple("∅" if v is None or (not isinstance(v, (list, tuple)) and not hasattr(v, "shape") and pd.isna(v)) else (f"{v:.6f}" if isinstance(v, float) else str(list(v)) if hasattr(v, "shape") and getattr(v, "shape", ()) else str(v)) for v in r))
    return sorted(rows)


def main(sf: str, names: list[str]) -> int:
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    q, sql = e.queries(), e.oracle_sql()
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings sample_corpus corpus_snapshots acts telemetry benchmark".split():
        con.execute(f"create view {t} as select * from read_parquet(['{sf}/{t}.parquet'])")
    bad = 0
    for n in names or list(q):
        t = time.time()
        try:
            got = q[n](spark, sf).toPandas()
        except Exception as x:
            print(n, "SPARK FAILED", str(x)[:1500])
            bad += 1
            continue
        took = time.time() - t
        if n not in sql:
            print(f"{n}: {len(got)} rows in {took:.1f} s, no SQL")
            continue
        try:
            t = time.time()
            want = con.execute(sql[n]).df()
        except Exception as x:
            print(n, "SQL FAILED", str(x)[:1500])
            bad += 1
            continue
        a, b = canon(got), canon(want)
        ok = a == b and sorted(got.columns) == sorted(want.columns)
        bad += not ok
        print(f"{n}: {'ok' if ok else 'DIFFERS'} {len(a)} {len(b)} rows, spark {took:.1f} s, sql {time.time() - t:.1f} s")
        if not ok:
            print("  columns", sorted(got.columns), sorted(want.columns))
            sa, sb = set(a), set(b)
            print("  only spark", [r for r in a if r not in sb][:4])
            print("  only sql", [r for r in b if r not in sa][:4])
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
