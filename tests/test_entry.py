"""The driver's contract: everything registered imports, and the SQL fits."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from dipfleet.jobs import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.queries().keys() >= registry.QUERIES.keys()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) & set(registry.ORACLES)) if not os.environ.get("QUICK") else [])
def test_query_equals_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    text = lambda d: sorted(str([None if x is None or x != x else round(float(x), 9) if not isinstance(x, str) else x for x in r]) for r in d[sorted(d.columns)].astype(object).where(d[sorted(d.columns)].notna(), None).itertuples(index=False))
    assert text(got) == text(want)
