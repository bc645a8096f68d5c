"""Compare a query with its SQL over one scale directory."""

import os

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"


def connect(path=DATA):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in os.listdir(path):
        if name.endswith(".parquet"):
            con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{path}/{name}'")
    return con


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    value = value.item() if hasattr(value, "item") else value
    return int(value) if isinstance(value, float) and value == int(value) else value


def rows(pdf):
    return sorted(str(tuple(plain(v) for v in r)) for r in pdf[sorted(pdf.columns)].itertuples(index=False))


def check(spark, con, query, sql, path=DATA):
    got, want = query(spark, path).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
