"""Compares queries with their SQL in DuckDB."""

import math
from pathlib import Path

import duckdb

SMALL = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differs(spark, query, sql, sf_dir=SMALL):
    """None, or what differs."""
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(sql)
    want = rows_of([d[0] for d in want.description], want.fetchall())
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if got[0] != want[0]:
        return f"columns {got[0]}, not {want[0]}"
    if got[1] != want[1]:
        return f"{len(got[1])} rows, {len(want[1])} wanted; first that differ: {next(((a, b) for a, b in zip(got[1], want[1]) if a != b), None)}"
    return None
