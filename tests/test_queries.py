"""Every query outside the llm package against its DuckDB twin on the smallest tables."""

import os

import duckdb
import pytest

from kvloom.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def hashed(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DIR)
    rows = [tuple(r) for r in df.collect()]
    if name in registry.ORACLES:
        twin = duck.sql(registry.ORACLES[name])
        assert hashed(df.columns, rows) == hashed(twin.columns, twin.fetchall())
    else:
        assert rows
