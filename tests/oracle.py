"""Compare a query with its SQL, rows as a multiset."""

from __future__ import annotations

import datetime
import math
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if hasattr(v, "as_tuple"):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def same_rows(df, con, sql: str) -> None:
    cols = sorted(df.columns)
    found = con.sql(sql)
    assert sorted(found.columns) == cols
    names = ", ".join(f'"{c}"' for c in cols)
    want = Counter(tuple(map(plain, r)) for r in con.sql(f"SELECT {names} FROM ({sql})").fetchall())
    have = Counter(tuple(map(plain, r)) for r in df.select(*cols).collect())
    assert have == want, (list((have - want).items())[:3], list((want - have).items())[:3])
