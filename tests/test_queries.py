"""Every registered core query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__  # noqa: F401  it registers the queries
from eventweave.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if hasattr(value, "asDict"):
        value = tuple(value)
    if isinstance(value, dict):
        return tuple(sorted((str(k), plain(v)) for k, v in value.items()))
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else repr(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_its_sql(spark, duck, name):
    rows = QUERIES[name](spark, SF)
    columns = sorted(rows.columns)
    found = duck.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in rows.collect()) == want
