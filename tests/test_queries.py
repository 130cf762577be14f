"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
import check
from tidewatch.plans.oracles import ORACLES
from tidewatch.plans.registry import QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="sample tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{file}'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert QUERIES.items() <= entry.queries().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    mine = entry.queries()[name](spark, SF_DIR).toPandas()
    theirs = duck.execute(entry.oracle_sql()[name]).df()
    assert check.difference(mine, theirs) is None


def test_entry_finds_anomalies(spark):
    assert entry.entry(spark).count() > 0


def test_difference_tells_apart():
    import pandas as pd

    a = pd.DataFrame({"x": [1, 2], "y": ["a", "b"]})
    assert check.difference(a.copy(), a[::-1].copy()) is None
    assert check.difference(a.copy(), a.assign(x=[1, 3])) is not None
    assert check.difference(a.copy(), a[:1].copy()) is not None
    assert check.difference(a.copy(), a.rename(columns={"x": "z"})) is not None
