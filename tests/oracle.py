"""Comparison of a Spark result with DuckDB over the same Parquet files."""

import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def same(df, con, sql):
    got = rows_of(df.columns, df.collect())
    table = con.sql(sql).to_arrow_table()
    want = rows_of(table.column_names, list(zip(*[c.to_pylist() for c in table.columns])) if table.num_rows else [])
    assert sorted(df.columns) == sorted(table.column_names)
    assert len(got) == len(want)
    assert got == want
