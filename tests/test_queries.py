"""Every registered query with SQL gives the rows of that SQL in DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from echogrid.plans import registry

registry.load()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "isoformat"):
        return str(v)
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def rows(table, names):
    return sorted((tuple(plain(r[n]) for n in names) for r in table), key=repr)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_like_sql(spark, oracle, name):
    df = registry.QUERIES[name](spark, SF)
    found = oracle.execute(registry.SQL[name])
    columns = [d[0] for d in found.description]
    table = [dict(zip(columns, r, strict=True)) for r in found.fetchall()]
    names = sorted(df.columns)
    assert names == sorted(columns)
    assert rows([r.asDict() for r in df.collect()], names) == rows(table, names)
