"""Run a registered query on Spark and its SQL on DuckDB, and compare the rows as multisets."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, (int, float)):
        return (2, f"{float(v):.6f}".replace("-0.000000", "0.000000"))
    return (3, str(v))


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(spark, query, sql, sf_dir, con=None):
    """None if equal, else a short text."""
    got = query(spark, sf_dir)
    got_rows = _rows(got.columns, [tuple(r) for r in got.collect()])
    cur = (con or duck(sf_dir)).execute(sql)
    names = [d[0] for d in cur.description]
    want_rows = _rows(names, cur.fetchall())
    if sorted(names) != sorted(got.columns):
        return f"columns {sorted(got.columns)} != {sorted(names)}"
    if got_rows == want_rows:
        return None
    only_got = [r for r in got_rows if r not in set(want_rows)][:2]
    only_want = [r for r in want_rows if r not in set(got_rows)][:2]
    return f"{len(got_rows)} rows vs {len(want_rows)}; spark {only_got} sql {only_want}"
