"""Runs queries and their SQL side by side on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

FOLDER = "/root/testdata/sf0.001"


def connect(folder: str):
    c = duckdb.connect()
    for p in sorted(Path(folder).glob("*.parquet")):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.is_file() else f'{p}/*.parquet'}'")
    return c


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (bool,)) or v is None or isinstance(v, str):
        return v
    return float(v) if not isinstance(v, (list, dict)) else str(v)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=lambda r: [str(x) for x in r])


def compare(spark, name: str, query, sql: str, folder: str = FOLDER) -> None:
    df = query(spark, folder)
    got = rows_of(df.columns, df.collect())
    cursor = connect(folder).execute(sql)
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    assert sorted(df.columns) == sorted(names), (name, df.columns, names)
    assert len(got) == len(want), (name, len(got), len(want))
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    assert not bad, (name, len(bad), bad[:2])
