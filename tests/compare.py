"""Spark rows against DuckDB rows, whatever their order."""

import datetime
import decimal
import math

import duckdb
import numpy as np
import pandas as pd

from corvine.tables import FIXTURES


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(map(plain, x))
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, float, np.number, decimal.Decimal)):
        return float(x)
    return str(x) if isinstance(x, (pd.Timestamp, datetime.datetime)) else x


def rows(frame):
    return sorted((tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None)), key=repr)


def reference(sql, sf):
    con = duckdb.connect()
    for t in FIXTURES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con.execute(sql).df()
