"""Runs a query and its oracle on the same tables and compares names, row counts and values."""

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)):
        return round(float(x), 9) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x) if not isinstance(x, (list, tuple)) else tuple(map(plain, x))


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in data], key=repr)


def compare(spark, name, run, sql, sf_dir):
    got = run(spark, sf_dir)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(got.columns) == sorted(names), (name, sorted(got.columns), sorted(names))
    a, b = rows(got.columns, [tuple(r) for r in got.collect()]), rows(names, cur.fetchall())
    assert len(a) == len(b), (name, len(a), len(b))
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    assert not bad, (name, len(bad), len(a), bad[:2])
    return len(a)
