"""The oracle: SQL over the tables of a folder in DuckDB, and a comparison of results without regard to order."""

import math
import os

import duckdb

from mediaspark.plans.fixtures import TABLES


def oracle(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    rel = con.sql(sql)
    return rel.columns, rel.fetchall()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def same(df, columns, rows) -> bool:
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    key = lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=key)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in rows), key=key)
    assert len(got) == len(want)
    assert got == want
    return True
