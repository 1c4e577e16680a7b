"""Every query that SQL can express, against DuckDB at the smallest scale."""

import json
import math

import duckdb
import pytest

from threadloom.plans import queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def canon(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return [canon(x) for x in v] if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DIR)
    rows, names = df.collect(), sorted(df.columns)
    assert rows or name in ("intent_dedup_cap",)
    if name not in queries.ORACLES:
        return
    want = duck.sql(queries.ORACLES[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(c) for c in names]
    key = lambda r: json.dumps(r, default=str)
    assert sorted(key([canon(r[c]) for c in names]) for r in rows) == sorted(key([canon(r[k]) for k in at]) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
