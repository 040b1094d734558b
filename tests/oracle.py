"""Compares a query with its SQL in DuckDB: sorted rows, columns by name."""

import glob
import os

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder):
    db = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.isdir(path):
            path += "/*.parquet"
        if glob.glob(path):
            db.execute(f"create view {t} as select * from '{path}'")
    return db


def plain(x):
    if x is None or (isinstance(x, float) and x != x) or str(x) in ("<NA>", "NaT"):
        return "null"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, float, np.integer, np.floating)):
        return repr(round(float(x), 6))
    return str(x)


def rows(frame, columns):
    return sorted(tuple(map(plain, r)) for r in frame[columns].astype(object).values.tolist())


def same(spark_frame, folder, sql):
    got, want = spark_frame.toPandas(), database(folder).execute(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = rows(got, columns), rows(want, columns)
    assert len(a) == len(b)
    assert a == b, next((x, y) for x, y in zip(a, b) if x != y)
