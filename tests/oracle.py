"""Run a query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return "null" if value is None else str(value)


def _sorted(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}


def difference(spark, con, run, sql, folder) -> str | None:
    """None when rows, names and types agree, else a short account."""
    df = run(spark, folder)
    got_names, got = _sorted([tuple(r) for r in df.collect()], df.columns)
    result = con.execute(sql)
    types = {d[0]: str(d[1]) for d in result.description}
    want_names, want = _sorted(result.fetchall(), list(types))
    if got_names != want_names:
        return f"columns {got_names} against {want_names}"
    wrong = {n: (t, types[n]) for n, t in df.dtypes if KINDS.get(t, t) != types[n]}
    if wrong:
        return f"types {wrong}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}" if bad else None
