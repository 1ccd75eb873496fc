"""Runs a query on Spark and its SQL on DuckDB over the same tables and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con


def plain(v):  # noqa: ANN001, ANN201
    if v is None or isinstance(v, (str, bool)):
        return v
    if isinstance(v, decimal.Decimal):
        return ("decimal", v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    return v


def rows_of_spark(df) -> tuple[list[str], list[tuple]]:  # noqa: ANN001
    names = sorted(df.columns)
    return names, [tuple(plain(r[c]) for c in names) for r in df.collect()]


def rows_of_sql(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], [tuple(plain(r[i]) for i in order) for r in cur.fetchall()]


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:  # noqa: ANN001
    """None if the rows are equal, else what differs."""
    a_names, a = rows_of_spark(df)
    b_names, b = rows_of_sql(con, sql)
    if a_names != b_names:
        return f"columns {a_names} and {b_names}"
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    a.sort(key=repr)
    b.sort(key=repr)
    bad = [(x, y) for x, y in zip(a, b) if repr(x) != repr(y)]
    return f"{len(bad)} of {len(a)} rows, as {bad[0]}" if bad else None
