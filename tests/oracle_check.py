"""Compare registered queries with DuckDB on the same parquet tables.

``python tests/oracle_check.py [sf_dir] [query ...]``
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _sorted(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), na_position="last").reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None if equal regardless of row and column order, else what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    kinds = {c: (got[c].dtype, want[c].dtype) for c in got.columns if got[c].dtype != want[c].dtype}
    # a column of integers with nulls is float64 on one side and Int64 on the other
    kinds = {c: k for c, k in kinds.items() if {str(x) for x in k} not in ({"object", "str"}, {"float64", "Int64"})}
    got, want = _sorted(got), _sorted(want)
    for c in got.columns:
        a, b = got[c], want[c]
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            at = (~same).idxmax()
            return f"{c}: {(~same).sum()} rows differ, first {a[at]!r} != {b[at]!r}"
    return f"types {kinds}" if kinds else None


def main(argv: list[str]) -> int:
    from flowsift.session import build_session
    import __spark_entry__ as entry

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        start = time.time()
        try:
            got = fn(spark, sf_dir).toPandas()
            took = time.time() - start
            if name not in oracles:
                print(f"rows  {name:24s} {took:6.2f}s {len(got)} rows", flush=True)
                continue
            problem = difference(got, con.execute(oracles[name]).df())
            print(f"{'ok   ' if problem is None else 'BAD  '} {name:24s} {took:6.2f}s {len(got)} rows"
                  f" (oracle {time.time() - start - took:.2f}s) {problem or ''}", flush=True)
            bad += problem is not None
        except Exception as e:  # keep going: one report for all queries
            bad += 1
            print(f"FAIL  {name:24s} {type(e).__name__}: {str(e)[:600]}", flush=True)
    spark.stop()
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
