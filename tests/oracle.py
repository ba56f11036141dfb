"""Runs a query and its DuckDB oracle over the same tables and compares the rows, whatever their order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def _cell(v):
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


def rows(columns, values):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in at], sorted(tuple(_cell(r[i]) for i in at) for r in values)


def compare(df, con, sql):
    got = rows(df.columns, df.collect())
    answer = con.execute(sql)
    expected = rows([d[0] for d in answer.description], answer.fetchall())
    assert got[0] == expected[0]
    assert got[1] == expected[1]
