"""Every query with a DuckDB twin gives its rows, over the smallest tables."""

import os

import duckdb
import pytest

from millrace.plans import registry

ORACLES = registry.oracle_sql()


def comparable(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return str(value)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(small):
        table = name.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, small, duck, name):
    df = registry.queries()[name](spark, small)
    got = sorted(([comparable(row[c]) for c in sorted(df.columns)] for row in df.collect()), key=repr)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(([comparable(dict(zip(names, row, strict=True))[c]) for c in sorted(names)] for row in result.fetchall()), key=repr)
    assert got == want


def test_every_query_has_a_twin():
    assert set(registry.queries()) == set(ORACLES)
