"""Spark-vs-DuckDB parity check used by the tests and runnable by hand.

    python tests/parity.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from stancelab.sources.tables import DRIVER_TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    try:
        import pandas as pd
        if v is pd.NA or v is pd.NaT:
            return None
    except ImportError:  # pragma: no cover
        pass
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(v) for v in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return cols, sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, con, name, sf_dir, query, sql, verbose=False):
    sdf = query(spark, sf_dir).toPandas()
    ddf = con.execute(sql).df()
    problems = []
    scols, srows = _rows(sdf)
    dcols, drows = _rows(ddf)
    if scols != dcols:
        problems.append(f"columns differ: spark={scols} duck={dcols}")
        return problems
    if len(srows) != len(drows):
        problems.append(f"row count spark={len(srows)} duck={len(drows)}")
    for c in scols:
        if str(sdf[c].dtype) != str(ddf[c].dtype):
            problems.append(f"dtype {c}: spark={sdf[c].dtype} duck={ddf[c].dtype}")
    bad = [(a, b) for a, b in zip(srows, drows) if a != b]
    if bad:
        problems.append(f"{len(bad)} differing rows, first: spark={bad[0][0]} duck={bad[0][1]}")
    if verbose:
        print(name, len(srows), "rows", "OK" if not problems else problems)
    return problems


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as e
    from stancelab.session import get_spark
    spark = get_spark()
    qs, os_ = e.queries(), e.oracle_sql()
    con = duck(sf_dir)
    failed = 0
    for name in names or sorted(qs):
        if name not in os_:
            print(name, "no oracle (rows only):", qs[name](spark, sf_dir).count())
            continue
        try:
            probs = compare(spark, con, name, sf_dir, qs[name], os_[name], verbose=True)
        except Exception as exc:  # noqa: BLE001
            print(name, "ERROR", type(exc).__name__, str(exc)[:2000])
            probs = ["error"]
        failed += bool(probs)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv))
