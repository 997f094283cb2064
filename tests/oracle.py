"""Runs a registered query beside its SQL in DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return ""
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float):
        return str(int(x)) if x.is_integer() else repr(round(x, 6))
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


def run_sql(sql, sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = con.execute(sql)
    columns = [c[0] for c in got.description]
    return columns, rows_of(columns, got.fetchall())


def compare(spark, query, sql, sf):
    df = query(spark, sf)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    columns, theirs = run_sql(sql, sf)
    assert sorted(df.columns) == sorted(columns)
    assert mine == theirs
