"""Comparison of a query with its SQL on the small given tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return None if v is None else str(v)


def check(spark, query, sql):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test data")
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    df = query(spark, FOLDER)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    want = Counter(tuple(plain(r[names.index(c)]) for c in order) for r in found.fetchall())
    got = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])


def runs(spark, query):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test data")
    assert query(spark, FOLDER).count() > 0
