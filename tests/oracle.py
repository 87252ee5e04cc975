"""Compare a registered query with its SQL counterpart, value by value."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, (datetime.datetime, datetime.date, bool)) or value is None:
        return str(value)
    return repr(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, con, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got_names = df.columns
    got = rows_of(got_names, df.collect())
    cursor = con.execute(sql)
    want_names = [c[0] for c in cursor.description]
    want = rows_of(want_names, cursor.fetchall())
    assert sorted(got_names) == sorted(want_names), (got_names, want_names)
    assert len(got) == len(want), f"{len(got)} rows, expected {len(want)}"
    differing = [(g, w) for g, w in zip(got, want) if g != w]
    assert not differing, f"{len(differing)} rows differ, first: {differing[0]}"
    return len(got)
