"""Queries of sliding and running statistics, over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import meters as M
from tessera.operators.common import r6
from tessera.plans.registry import query, table


@query(
    """SELECT event_id, round(quantile_cont(value, 0.5) OVER w, 6) AS median, round(avg(value) OVER w, 6) AS mean, max(value) OVER w AS most, last_value(value) OVER w AS latest
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"""
)
def sliding_meter(spark, d):
    s = M.sliding(table(spark, d, "events"), "value", ["user_id"], ["ts", "event_id"])
    return s.select("event_id", r6(F.col("median")).alias("median"), r6(F.col("mean")).alias("mean"), "most", "latest")


@query(
    """SELECT event_id, round(avg(value) OVER w, 6) AS global_mean, coalesce(sum(length(props)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"""
)
def running_avg(spark, d):
    e = table(spark, d, "events").withColumn("size", F.length("props"))
    s = M.sliding(M.addresses(e, "size", ["user_id"], ["ts", "event_id"]), "value", ["user_id"], ["ts", "event_id"])
    return s.select("event_id", r6(F.col("global_mean")).alias("global_mean"), "start")


@query(
    """WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT user_id, i, value AS v FROM o WHERE i = 1 UNION ALL
  SELECT o.user_id, o.i, CASE WHEN o.i - 1 < 10 THEN 0.9 * v + 0.1 * value ELSE 0.99 * v + (1 - 0.99) * value END FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)
SELECT user_id, i AS n, round(v, 6) AS ema FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1"""
)
def ema(spark, d):
    return M.ema(table(spark, d, "events"), "value", ["user_id"], ["ts", "event_id"]).withColumn("ema", r6(F.col("ema")))


@query(
    """WITH s AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM s)
SELECT user_id, island, min(event_type) AS event_type, count(*) AS n FROM i GROUP BY 1, 2"""
)
def islands(spark, d):
    marked = M.islands(table(spark, d, "events"), "event_type", ["user_id"], ["ts", "event_id"])
    return marked.groupBy("user_id", "island").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"))
