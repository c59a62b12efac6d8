"""Run registered queries next to their SQL and report differences: check.py [sf] [name-prefix...]"""

import os
import sys
import time
import traceback

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = """region nation customer supplier part orders lineitem events documents embeddings pages
benchmark labels conversations""".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(got: pd.DataFrame, want: pd.DataFrame):
    """None when equal as bags of rows, else a short description."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    cols = sorted(got.columns)
    kinds = [(c, got[c].dtype.kind, want[c].dtype.kind) for c in cols
             if got[c].dtype != want[c].dtype]
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a = sorted(map(repr, got[cols].itertuples(index=False, name=None)))
    b = sorted(map(repr, want[cols].itertuples(index=False, name=None)))
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        first = [(x[:300], y[:300]) for x, y in bad[:2]]
        return f"{len(bad)} of {len(a)} rows differ {first} types {kinds}"
    return f"types {kinds}" if kinds else None


def main():
    from textloom.plans.registry import load
    from textloom.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    queries, oracles = load()
    picked = [n for n in queries if not sys.argv[2:] or n.startswith(tuple(sys.argv[2:]))]
    spark, con = local_session(), connect(sf_dir)
    bad = 0
    for name in picked:
        t0 = time.time()
        try:
            got = queries[name](spark, sf_dir).toPandas()
            t1 = time.time()
            if name in oracles:
                want = con.sql(oracles[name]).df()
                problem = compare(got, want)
            else:
                problem = None if len(got) else "no rows"
            kind = "sql" if name in oracles else "rows"
        except Exception as e:
            t1, got, kind = time.time(), [], "error"
            problem = f"{type(e).__name__}: {str(e)[:1200]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += problem is not None
        print(f"{name:32s} {kind:5s} {len(got):7d} rows {t1 - t0:6.2f}s sql {time.time() - t1:5.2f}s "
              f"{'ok' if problem is None else 'BAD ' + problem}", flush=True)
    print(f"{len(picked)} checked, {bad} bad")


if __name__ == "__main__":
    main()
