"""Runs a registered query and its SQL and compares the two results as multisets of rows."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _key(value):
    if value is None:
        return (0, "")
    if isinstance(value, float):
        return (1, "nan") if math.isnan(value) else (1, f"{value:.6g}")
    return (1, str(value))


def _same(a, b) -> bool:
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None:
            return a is b
        return float(a) == float(b) or math.isclose(float(a), float(b), rel_tol=1e-9, abs_tol=1e-9)
    return a == b and type(a) is type(b)


def compare(spark, con, folder: str, run, sql: str) -> tuple[str | None, int, float, float]:
    """(problem or None, rows, spark seconds, sql seconds)"""
    t0 = time.time()
    df = run(spark, folder)
    names = sorted(df.columns)
    mine = [tuple(r[n] for n in names) for r in df.collect()]
    t1 = time.time()
    cur = con.execute(sql)
    theirs_names = [c[0] for c in cur.description]
    rows = cur.fetchall()
    t2 = time.time()
    if sorted(theirs_names) != names:
        return f"columns differ: {names} / {sorted(theirs_names)}", len(mine), t1 - t0, t2 - t1
    order = [theirs_names.index(n) for n in names]
    theirs = [tuple(r[i] for i in order) for r in rows]
    if len(mine) != len(theirs):
        return f"row counts differ: {len(mine)} / {len(theirs)}", len(mine), t1 - t0, t2 - t1
    mine.sort(key=lambda r: tuple(map(_key, r)))
    theirs.sort(key=lambda r: tuple(map(_key, r)))
    bad = 0
    first = ""
    exact = 0
    for a, b in zip(mine, theirs):
        if a != b:
            exact += 1
        wrong = [i for i in range(len(names)) if not _same(a[i], b[i])]
        if wrong:
            bad += 1
            first = first or f"{ {names[i]: (a[i], b[i]) for i in wrong} } in {a}"
    if bad:
        return f"{bad} rows differ, e.g. {first}", len(mine), t1 - t0, t2 - t1
    if exact:
        return f"NOTE {exact} rows equal only within 1e-9", len(mine), t1 - t0, t2 - t1
    return None, len(mine), t1 - t0, t2 - t1
