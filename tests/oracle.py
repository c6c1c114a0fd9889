"""Comparison of a query's rows with its DuckDB SQL."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def connect(sf=SF):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def check(spark, query, sql, sf=SF):
    df = query(spark, sf)
    names = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    rel = connect(sf).sql(sql)
    at = [rel.columns.index(c) for c in names]
    assert sorted(rel.columns) == names
    want = sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())
    assert got == want
