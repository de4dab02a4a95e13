"""Runs a registered query and its SQL side by side, and tells rows that only one of them has."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(normal(r[i]) for i in order) for r in rows)


def compare(spark, query, sql: str, sf_dir: str) -> tuple[Counter, Counter, list, list]:
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    done = con.execute(sql)
    names = [d[0] for d in done.description]
    want = rows_of(names, done.fetchall())
    return got - want, want - got, sorted(df.columns), sorted(names)


def check(spark, query, sql: str, sf_dir: str) -> None:
    more, less, a, b = compare(spark, query, sql, sf_dir)
    assert a == b, (a, b)
    assert not more and not less, (list(more)[:3], list(less)[:3], len(more), len(less))
