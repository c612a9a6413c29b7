"""Runs registered queries next to their SQL and compares the rows.

    python -m checks [--sf DIR] [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import time

QUERIES: dict[str, object] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    """Registers a query (spark, sf_dir) -> DataFrame and the SQL it must agree with."""

    def register(make):
        QUERIES[name] = make
        if sql is not None:
            ORACLES[name] = sql
        return make

    return register


def duck_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, int):
        return value
    return str(value)


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    data = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(data, key=repr)


def compare(spark, con, sf_dir: str, name: str) -> str:
    start = time.time()
    frame = QUERIES[name](spark, sf_dir)
    columns, got = _table(frame.columns, [tuple(r) for r in frame.collect()])
    spent = time.time() - start
    if name not in ORACLES:
        return f"ROWS  {name}: {len(got)} rows in {spent:.1f}s"
    start = time.time()
    cursor = con.execute(ORACLES[name])
    want_columns, want = _table([c[0] for c in cursor.description], cursor.fetchall())
    other = time.time() - start
    note = f"{name}: {len(got)}/{len(want)} rows, {spent:.1f}s / {other:.1f}s"
    if columns != want_columns:
        return f"FAIL  {note}\n      columns {columns} / {want_columns}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        missing = [r for r in want if r not in set(got)][:2]
        return f"FAIL  {note}\n      {columns}\n      only Spark {extra}\n      only SQL   {missing}"
    return f"ok    {note}"
