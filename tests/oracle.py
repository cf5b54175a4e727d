"""Comparison of a query's rows with those of its oracle SQL, in any order."""

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) and glob.glob(p) else p}')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    return round(v, 9) if isinstance(v, float) else v


def rows(names, values, columns):
    at = [names.index(c) for c in columns]
    return sorted((tuple(plain(r[i]) for i in at) for r in values), key=repr)


def check(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got = df.collect()
    rel = connect(sf_dir).sql(sql)
    columns = sorted(rel.columns)
    assert sorted(df.columns) == columns
    a, b = rows(df.columns, got, columns), rows(rel.columns, rel.fetchall(), columns)
    assert a == b
