"""Compare registered queries with their SQL on the small tables."""

import math
import os

import duckdb

from conftest import DATA


def connect():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


def _plain(x):
    if x is None:
        return None
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    return x if isinstance(x, (bool, int, str)) else str(x)


def compare(spark, con, query, sql):
    df = query(spark, DATA)
    got = df.collect()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted((tuple(_plain(r[names.index(c)]) for c in order) for r in cur.fetchall()), key=repr)
    have = sorted((tuple(_plain(r[c]) for c in order) for r in got), key=repr)
    assert have == want
