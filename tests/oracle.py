"""Run queries next to their SQL twins and compare schema, row count and values.

    python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _kind(s: pd.Series) -> str:
    k = s.dtype.kind
    if k == "O":
        v = next((x for x in s if x is not None and x == x), None)
        return type(v).__name__
    return {"i": "int", "u": "int"}.get(k, k)


def _canon(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "~"
        if isinstance(v, float):
            return repr(float(v))
        if hasattr(v, "tolist"):
            return repr(v.tolist())
        return repr(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(cell(v) for v in row) for row in df.astype(object).itertuples(index=False, name=None))


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = _canon(got), _canon(want)
    bad = sum(x != y for x, y in zip(a, b))
    if bad:
        i = next(i for i, (x, y) in enumerate(zip(a, b)) if x != y)
        return f"{bad} of {len(a)} rows differ, e.g. {a[i]} != {b[i]} {sorted(got.columns)}"
    kinds = [(c, _kind(got[c]), _kind(want[c])) for c in got.columns if len(got) and got[c].notna().all()]
    odd = [k for k in kinds if k[1] != k[2]]
    return f"types differ {odd}" if odd else "ok"


def run(spark, con, sf_dir: str, name: str) -> tuple[str, int, float, float]:
    from tessera.plans import catalog

    t0 = time.time()
    got = catalog.queries()[name](spark, sf_dir).toPandas()
    t1 = time.time()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        return "rows only", len(got), t1 - t0, 0.0
    want = con.execute(sql).fetch_df() if hasattr(con, "fetch_df") else con.execute(sql).df()
    return compare(got, want), len(got), t1 - t0, time.time() - t1


def main() -> int:
    from tessera.plans import catalog
    from tessera.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = [n for n in catalog.queries() if not args or any(n == a or n.startswith(a.rstrip("*")) and a.endswith("*") for a in args)]
    spark, con = local_session(8), duck(sf_dir)
    failed = 0
    for name in names:
        try:
            status, rows, s, d = run(spark, con, sf_dir, name)
        except Exception as e:  # report and go on with the next query
            status, rows, s, d = f"ERROR {str(e)[:700]}", -1, 0, 0
        good = status in ("ok", "rows only") and rows > 0
        failed += not good
        print(f"{'  ' if good else '**'} {name}: {status} rows={rows} spark={s:.1f}s duck={d:.1f}s", flush=True)
    print(f"{len(names) - failed} of {len(names)} good")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
