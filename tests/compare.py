"""Order-insensitive comparison of a query with its SQL."""

import datetime
import math
from pathlib import Path

import duckdb


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(_norm, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def check(spark, queries, sql, name, d):
    df = queries[name](spark, d)
    cols = sorted(df.columns)
    rows = sorted(tuple(_norm(x) for x in r) for r in df.select(*cols).collect())
    if name not in sql:
        return rows
    c = duckdb.connect()
    for p in Path(d).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    r = c.execute(sql[name])
    got = [x[0] for x in r.description]
    assert sorted(got) == cols
    at = [got.index(k) for k in cols]
    assert rows == sorted(tuple(_norm(x[i]) for i in at) for x in r.fetchall())
    return rows
