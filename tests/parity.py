"""Compare queries with their SQL in DuckDB: names, rows and values, whatever the order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.sql(f"create view {name} as from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _sorted(rows):
    return sorted((tuple(_plain(x) for x in row) for row in rows), key=lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r])


def difference(df, text, con):
    """Why the two differ; nothing if they are equal."""
    names = sorted(df.columns)
    answer = con.sql(text)
    if sorted(answer.columns) != names:
        return f"columns {names} and {sorted(answer.columns)}"
    mine = _sorted([tuple(r) for r in df.select(*names).collect()])
    theirs = _sorted(answer.select(*[duckdb.ColumnExpression(n) for n in names]).fetchall())
    if len(mine) != len(theirs):
        return f"{len(mine)} and {len(theirs)} rows"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"{a} and {b}"
    types = [t for _, t in sorted(df.dtypes)]
    kinds = [str(t).lower() for _, t in sorted(zip(answer.columns, answer.types))]
    same = {"bigint": "bigint", "int": "integer", "double": "double", "string": "varchar", "boolean": "boolean", "date": "date"}
    off = [(n, t, k) for n, t, k in zip(names, types, kinds) if t in same and same[t] != k]
    return f"types {off}" if off else ""
