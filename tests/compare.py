"""Holds queries against their SQL twins run by DuckDB: columns by name, rows as multisets."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(value)
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def compare(spark, sf_dir: str, query, sql: str) -> str:
    """An empty text, or what differs."""
    df = query(spark, sf_dir)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(sql)
    names, rows = [x[0] for x in found.description], found.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} but {sorted(names)}"
    order = [names.index(c) for c in sorted(names)]
    want = Counter(tuple(plain(r[i]) for i in order) for r in rows)
    have = Counter(tuple(plain(x) for x in r) for r in df.select(*sorted(df.columns)).collect())
    if want == have:
        return ""
    return f"{sum(have.values())} rows but {sum(want.values())}; only here {list((have - want).items())[:3]}; only there {list((want - have).items())[:3]}"
