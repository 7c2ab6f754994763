"""Results of both engines as comparable rows."""

import os

import duckdb
import numpy as np
import pandas as pd

DATA = os.environ.get("METHYRA_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(d: str = DATA):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    return con


def _plain(x):
    if x is None or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, float, np.integer, np.floating)):
        return round(float(x), 6) + 0.0
    return str(x)


def rows(df: pd.DataFrame) -> list:
    return sorted(tuple(repr(_plain(x)) for x in r) for r in df[sorted(df.columns)].astype(object).values.tolist())
