"""Holds a query's rows against its SQL's in DuckDB."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, sf_dir, query, sql):
    """Number of rows; fails where the two differ."""
    con = connect(sf_dir)
    found = con.execute(sql)
    names, want = [d[0] for d in found.description], found.fetchall()
    df = query(spark, sf_dir)
    assert sorted(df.columns) == sorted(names), (sorted(df.columns), sorted(names))
    got, want = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, want)
    assert len(got) == len(want), (len(got), len(want))
    for a, b in zip(got, want, strict=True):
        assert a == b, (a, b)
    return len(got)
