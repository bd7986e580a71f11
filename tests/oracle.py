"""Compares a query with its SQL twin in DuckDB."""

from __future__ import annotations

import datetime
import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def ordered(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def assert_same(df, connection, sql: str) -> None:
    columns = sorted(df.columns)
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    assert ordered(df.select(columns).collect()) == ordered(tuple(r[i] for i in place) for r in cursor.fetchall())
