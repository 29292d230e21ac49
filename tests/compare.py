"""Holds queries against their SQL: same columns, same rows in any order, doubles to nine digits."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if (path := Path(sf_dir, f"{name}.parquet")).exists():
            files = f"{path}/*.parquet" if path.is_dir() else path
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{files}')")
    return con


def canon(value):
    if value is None or isinstance(value, (str, bool, int)):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(canon, value))
    if isinstance(value, dict):
        return tuple(sorted((str(k), canon(v)) for k, v in value.items()))
    return str(value)


def rows(names: list[str], found) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(canon(row[i]) for i in order) for row in found), key=repr)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), rows(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    return sorted(names), rows(names, found.fetchall())


def assert_same(df, con, sql: str) -> None:
    names, got = spark_rows(df)
    sql_names, expected = sql_rows(con, sql)
    assert names == sql_names
    assert len(got) == len(expected), (len(got), len(expected))
    wrong = [(a, b) for a, b in zip(got, expected, strict=True) if a != b]
    assert not wrong, (len(wrong), wrong[:3])
