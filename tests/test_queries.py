"""Every query that has an oracle against that oracle, on the smallest tables."""

import decimal

import duckdb
import pytest

from tidemark.plans.registry import FLAGSHIP, ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    value = lambda v: round(float(v), 6) if isinstance(v, (float, decimal.Decimal)) else v
    return sorted((tuple(map(value, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(ORACLES))
def test_same_rows(spark, oracle, name):
    got, want = QUERIES[name](spark, SF), oracle.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    rows = oracle.sql(f"SELECT {', '.join(f'"{c}"' for c in order)} FROM ({ORACLES[name]})").fetchall()
    assert plain(got.select(*order).collect()) == plain(rows)


def test_entry(spark):
    import __spark_entry__ as e

    assert FLAGSHIP in e.queries() and e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
