"""Run a registered query and its SQL on the same tables and compare every value."""

from __future__ import annotations

import math

import duckdb

from taxograft.workload.registry import TABLES


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return "~null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{round(v, 6) + 0.0:.6f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(spark, con, folder, fn, sql):
    df = fn(spark, folder)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = table([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}", len(got[1])
    if got[1] == want[1]:
        return None, len(got[1])
    a, b = set(got[1]), set(want[1])
    return (
        f"rows {len(got[1])} vs {len(want[1])}; only spark {sorted(a - b)[:3]}; only sql {sorted(b - a)[:3]}",
        len(got[1]),
    )
