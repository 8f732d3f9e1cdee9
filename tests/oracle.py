"""Runs a query in Spark and its SQL in DuckDB, and gives both results in one comparable form."""

import math
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


def rows(frame, columns):
    return sorted((tuple(map(plain, r)) for r in frame[columns].itertuples(index=False, name=None)), key=repr)


def both(spark, sf, query, sql):
    db = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    got, want = query(spark, sf).toPandas(), db.sql(sql).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    return rows(got, columns), rows(want, columns)
