"""Runs a registered query and its DuckDB oracle over the same tables and compares rows as multisets."""

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, list | tuple):
        return str([value(x) for x in v])
    return str(v)


def compare(spark, fn, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(sql)
    columns = sorted(want.columns)
    df = fn(spark, sf_dir)
    assert sorted(df.columns) == columns, (sorted(df.columns), columns)
    got = Counter(tuple(value(r[c]) for c in columns) for r in df.collect())
    order = [want.columns.index(c) for c in columns]
    expected = Counter(tuple(value(r[i]) for i in order) for r in want.fetchall())
    extra, missing = got - expected, expected - got
    assert not extra and not missing, f"{sum(got.values())} rows, {sum(expected.values())} wanted; extra {list(extra)[:4]}; missing {list(missing)[:4]}"
    return sum(got.values())
