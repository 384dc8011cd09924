"""Compare every registered query with its SQL in DuckDB: names, row counts, values."""

from __future__ import annotations

import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in data), key=repr)


def compare(spark, con, sf, q):
    """None when equal, else a short description of the difference."""
    df = q.run(spark, sf)
    got_cols, got = rows(df.columns, df.collect())
    if q.sql is None:
        return None if got else "no rows"
    res = con.sql(q.sql)
    want_cols, want = rows(res.columns, res.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    if not got:
        return "both empty"
    for g, w in zip(got, want):
        if g != w:
            return f"got {g}, expected {w}"
        if [type(a) for a in g] != [type(b) for b in w]:
            return f"types of {g} and {w}: {[type(a) for a in g]} {[type(b) for b in w]}"
    return None


def main(argv):
    sys.path.insert(0, str(__import__("pathlib").Path(__file__).resolve().parents[1]))
    from panelworks.session import local_session
    from panelworks.workload.catalog import load

    sf, names = argv[0], set(argv[1:])
    spark, con = local_session(), duck(sf)
    spark.sparkContext.setLogLevel("ERROR")
    bad = n = 0
    for q in load().values():
        if names and q.name not in names and not any(q.name.startswith(p[:-1]) for p in names if p.endswith("*")):
            continue
        t0 = time.time()
        try:
            diff = compare(spark, con, sf, q)
        except Exception as e:  # report and go on
            diff = f"{type(e).__name__}: {str(e)[:700]}"
        bad += diff is not None
        n += 1
        mark = "ok " if diff is None else "BAD"
        print(f"{mark} {q.name:28s} {time.time() - t0:6.2f}s {'E' if q.sql else 'R'} {diff or ''}", flush=True)
    print(f"{n} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
