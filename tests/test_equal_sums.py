"""Tokens whose sums are equal tie, in whatever order their values were added."""

import datetime

import duckdb
from pyspark.sql import functions as F

from tessera.plans import catalogue


def test_nucleus_keeps_both_of_a_tie(spark, tmp_path):
    same = [7.21, 94.01, 72.15, 14.72, 34.2, 29.85, 52.72, 77.73]  # added from either end, their sum is another double
    values = {"click": [422.59], "error": same, "view": same[::-1]}
    rows = [(k, datetime.datetime(2024, 1, 1), 1, token, v, "{}") for k, (token, v) in enumerate((t, v) for t, vs in values.items() for v in vs)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    kept = {r.token: r.top_k for r in catalogue.queries()["nucleus"](spark, str(tmp_path)).collect()}
    assert kept == {"click": True, "error": True, "view": True}


def test_long_sums_tie(spark, tmp_path):
    # added from either end, the sums of 10,000 values differ in the ninth decimal
    value = F.when(F.col("token") == "click", 5e6).otherwise((F.when(F.col("token") == "error", F.col("id")).otherwise(9999 - F.col("id")) * 7919 % 100003) / 100)
    rows = spark.range(10_000).crossJoin(spark.createDataFrame([("click",), ("error",), ("view",)], "token string")).where("token != 'click' OR id = 0")
    events = rows.orderBy("token", "id").select(F.col("id").alias("event_id"), F.lit(1).cast("long").alias("user_id"), F.col("token").alias("event_type"), value.alias("value"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    kept = {r.token: r.top_k for r in catalogue.queries()["nucleus"](spark, str(tmp_path)).collect()}
    assert kept == {"click": True, "error": True, "view": True}


def test_nulls_are_where_the_sql_has_them(spark, tmp_path):
    values = {(1, "click"): 5.0, (1, "view"): 30.0, (1, "error"): None, (2, None): 5.25, (2, "click"): 5.25, (2, "view"): 5.25, (3, None): None, (3, "view"): None}
    rows = [(k, datetime.datetime(2024, 1, 1), user, token, v, "{}") for k, ((user, token), v) in enumerate(values.items())]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name in ("nucleus", "min_p", "rank_of"):
        got = [tuple(r) for r in catalogue.queries()[name](spark, str(tmp_path)).collect()]
        assert sorted(got, key=str) == sorted(con.sql(catalogue.oracle_sql()[name]).fetchall(), key=str)
