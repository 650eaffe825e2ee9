"""Run registered queries against their SQL: python tests/compare.py [sf] [name ...]."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None:
            return "~"
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v + 0.0)
        return f"{type(v).__name__} {v}"

    return [columns[i] for i in order], sorted("|".join(cell(r[i]) for i in order) for r in rows)


def same(df, con, sql):
    """Problems found between a DataFrame and the SQL result, empty if equal."""
    got_cols, got = canonical(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    want_cols, want = canonical(names, res.fetchall())
    problems = []
    if got_cols != want_cols:
        problems.append(f"columns {got_cols} vs {want_cols}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} vs {len(want)}")
    if got != want:
        a, b = set(got), set(want)
        problems.append(f"only here {sorted(a - b)[:3]}; only SQL {sorted(b - a)[:3]}")
    return len(got), problems


def main(argv):
    import __spark_entry__ as entry
    from bench import session
    from coterie.functions.frames import forget_settled

    sf = argv[1] if len(argv) > 1 else "sf0.01"
    sf_dir = f"/root/testdata/{sf}"
    names = argv[2:] or list(entry.queries())
    spark = session(8)
    con = connect(sf_dir)
    oracle = entry.oracle_sql()
    bad = 0
    for n in names:
        t = time.time()
        try:
            df = entry.queries()[n](spark, sf_dir)
            if n in oracle:
                rows, problems = same(df, con, oracle[n])
            else:
                rows, problems = df.count(), []
        except Exception as e:  # report and go on with the next query
            rows, problems = -1, [f"{type(e).__name__}: {str(e)[:1500]}"]
        forget_settled(spark)
        bad += bool(problems)
        mark = "FAIL" if problems else ("ok" if n in oracle else "rows")
        print(f"{mark:5}{n:30}{rows:8}{time.time() - t:8.1f}s {' '.join(problems)}", flush=True)
    print("bad", bad)


if __name__ == "__main__":
    main(sys.argv)
