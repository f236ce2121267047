"""Holds a query against its SQL in DuckDB."""

import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con


def rows_of(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is None, str(type(x).__name__ == "str"), x if x is not None else 0) for x in r])


def same(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    found = connect(sf_dir).sql(sql)
    assert sorted(found.columns) == names
    at = [found.columns.index(n) for n in names]
    theirs = rows_of(tuple(r[i] for i in at) for r in found.fetchall())
    assert rows_of(df.select(*names).collect()) == theirs
