"""Compare a query with its SQL on one data directory."""

import datetime
import math
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime) and v.tzinfo:
        return v.astimezone(datetime.timezone.utc).replace(tzinfo=None)
    return v


def connect():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for f in sorted(os.listdir(DATA)):
        c.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


def check(spark, query, sql):
    df = query(spark, DATA)
    names = sorted(df.columns)
    ours = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    theirs = connect().sql(sql)
    assert sorted(theirs.columns) == names
    rows = theirs.select(*[f'"{n}"' for n in names]).fetchall()
    assert ours == sorted((tuple(map(plain, r)) for r in rows), key=repr)
