"""Side-by-side comparison of a registered query and its SQL."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if hasattr(value, "isoformat"):
        return value.isoformat()[:10]
    return repr(value)


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def difference(df, con, sql: str) -> str | None:
    """None if equal, else what differs first."""
    got = sorted_rows(df.columns, df.collect())
    result = con.execute(sql)
    want = sorted_rows([d[0] for d in result.description], result.fetchall())
    if got[0] != want[0]:
        return f"columns {sorted(set(got[0]) ^ set(want[0]))}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} vs {len(want[1])}"
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    if bad:
        g, w = bad[0]
        cells = [(c, x, y) for c, x, y in zip(got[0], g, w) if x != y]
        return f"{len(bad)} rows differ, e.g. {g[:3]}: {cells[:4]}"
    return None
