"""Runs a query in Spark and its SQL in DuckDB and compares the rows, columns by name."""

import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def plain(x):
    if x is None or isinstance(x, str | bool):
        return x
    return None if isinstance(x, float) and math.isnan(x) else round(float(x), 6)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)


def duck_rows(con, sql: str):
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in got.fetchall()), key=repr)
