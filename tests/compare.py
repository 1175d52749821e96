"""Spark results against DuckDB's, as sets of rows with columns by name."""

import datetime
import decimal
import math
import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (float, np.floating)):
        return round(float(v), 9)
    if isinstance(v, decimal.Decimal):
        return "decimal", str(v)
    if isinstance(v, np.integer):
        return int(v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(pd.Timestamp(v))
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, ordered(tuple(plain(r.asDict(True)[c]) for c in cols) for r in df.collect())


def duck_rows(con, sql):
    rel = con.execute(sql)
    names = [x[0] for x in rel.description]
    cols = sorted(names)
    return cols, ordered(tuple(plain(dict(zip(names, r))[c]) for c in cols) for r in rel.fetchall())
