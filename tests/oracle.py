"""Run a query and its DuckDB SQL on the same tables and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def tables(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        source = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"create view {p.stem} as select * from '{source}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    if isinstance(x, decimal.Decimal):
        return plain(float(x))
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    if isinstance(x, datetime.datetime) and x.tzinfo:
        return x.astimezone(datetime.UTC).replace(tzinfo=None)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def difference(spark, sf_dir: str, query, sql: str) -> str:
    """Empty if the query's rows are those of the SQL."""
    frame = query(spark, sf_dir)
    got = rows(frame.columns, frame.collect())
    found = tables(sf_dir).execute(sql)
    names = [c[0] for c in found.description]
    want = rows(names, found.fetchall())
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} against {sorted(names)}"
    if got == want:
        return ""
    odd = [(a, b) for a, b in zip(got, want, strict=False) if a != b][:2]
    return f"{len(got)} rows against {len(want)}: {odd}"[:2000]
