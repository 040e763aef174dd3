"""Every query against its SQL twin on the smallest tables."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tessera.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in Path(FOLDER).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    got = catalogue.queries()[name](spark, FOLDER)
    cols = sorted(got.columns)
    want = con.sql(catalogue.oracle_sql()[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert ordered([tuple(plain(r[c]) for c in cols) for r in got.collect()]) == ordered([tuple(plain(r[i]) for i in at) for r in want.fetchall()])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert catalogue.queries()[name](spark, FOLDER).count() > 0


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).columns == ["item_id", "slot", "chosen_score", "rejected_score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
