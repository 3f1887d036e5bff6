"""Compares a query's rows with DuckDB's on the same Parquet tables."""

import datetime
import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir, sql):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = c.execute(sql)
    columns = [d[0] for d in got.description]
    return sorted(columns), rows_of(columns, got.fetchall())


def assert_same(df, sf_dir, sql):
    columns, expected = duck(sf_dir, sql)
    assert sorted(df.columns) == columns
    assert rows_of(df.columns, df.collect()) == expected
