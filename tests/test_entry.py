"""The registered queries against their SQL in DuckDB, and the driver's contract."""

import math

import duckdb
import pytest

import __spark_entry__
from tidemark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6)
    return a == b


def rows(names, got):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in got), key=lambda r: tuple((x is None, str(type(x)), round(x, 4) if isinstance(x, float) else x if x is not None else 0) for x in r))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    mine = rows(df.columns, df.collect())
    out = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in out.description]
    theirs = rows(names, out.fetchall())
    assert sorted(df.columns) == sorted(names) and len(mine) == len(theirs)
    assert all(close(x, y) for a, b in zip(mine, theirs) for x, y in zip(a, b))


def test_contract(spark):
    out = __spark_entry__.entry(spark)
    assert out.count() == 25 and out.columns[0] == "symbol"
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
