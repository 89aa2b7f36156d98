"""A registered query against its SQL, on the small driver tables."""

import math
import os

import duckdb
import pandas as pd


def _plain(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


def connection(folder):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(folder):
        path = f"{folder}/{f}" + ("/*.parquet" if os.path.isdir(f"{folder}/{f}") else "")
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{path}')")
    return c


def rows_of(df):
    columns = sorted(df.columns)
    return sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def sql_rows(c, sql):
    result = c.execute(sql)
    names = [d[0] for d in result.description]
    order = [names.index(n) for n in sorted(names)]
    return sorted((tuple(_plain(r[i]) for i in order) for r in result.fetchall()), key=repr)
