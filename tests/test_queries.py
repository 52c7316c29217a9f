"""Every query against its SQL in DuckDB."""

import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


def plain(v):
    return str(v.normalize() + 0) if isinstance(v, Decimal) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLE)))
def test_query_equals_its_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    got = con.execute(ORACLE[name])
    columns = sorted(c[0] for c in got.description)
    assert sorted(df.columns) == columns
    at = [[c[0] for c in got.description].index(c) for c in columns]
    expected = sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == expected


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["status", "order_count", "with_coupon", "revenue", "avg_order_value"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
