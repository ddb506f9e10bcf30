"""Rows of a query and of its SQL, made comparable."""

import glob
import numbers
import os

import duckdb
import pandas as pd

FOLDER = "/root/testdata/sf0.001"


def cell(x):
    if x is None or (not hasattr(x, "__len__") and pd.isna(x)):
        return "-"
    if isinstance(x, numbers.Number) and not isinstance(x, bool):
        return repr(round(float(x), 9))
    return str(x)


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple(map(cell, r)) for r in pdf.itertuples(index=False))


def connection():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def check(spark, query, sql):
    df = query(spark, FOLDER)
    con = connection()
    kinds = {r[0]: r[1] for r in con.execute(f"describe {sql}").fetchall()}
    assert {c: TYPES.get(k, k) for c, k in df.dtypes} == kinds
    assert rows(df.toPandas()) == rows(con.execute(sql).fetch_df())
