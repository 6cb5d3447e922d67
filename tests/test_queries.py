"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

import annolith.plans  # noqa: F401
from annolith.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return "null" if value is None else str(value)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, sf, name):
    frame = registry.queries()[name](spark, sf)
    found = duck.execute(registry.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(frame.columns) == sorted(names)
    want = sorted(tuple(map(plain, r)) for r in found.fetchall())
    got = sorted(tuple(map(plain, r)) for r in frame.select(*[f"`{n}`" for n in names]).collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, sf, name):
    frame = registry.queries()[name](spark, sf)
    assert len(frame.collect()) > 0
