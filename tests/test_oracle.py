"""Every registered query against its oracle text, value by value, at the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from midmile.plans.views import TABLES

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else x + 0.0
    return x.isoformat() if hasattr(x, "isoformat") else x


def ordered(rows):
    return sorted((tuple(value(v) for v in r) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    got = QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    rows = [[r[c] for c in columns] for r in got.collect()]
    if name not in ORACLES:
        assert rows
        return
    result = oracle.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = [[r[names.index(c)] for c in columns] for r in result.fetchall()]
    assert ordered(rows) == ordered(want)


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert {r.verdict for r in rows} == {"PASS", "HARD_VETO"}
