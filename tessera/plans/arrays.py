"""Queries of distributions, token filters and masks, over events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import arrays as A
from tessera.operators.common import laid_out, r6, summed
from tessera.operators.regions import labelled_components
from tessera.plans.registry import query, table

_SOFT = """WITH e AS (SELECT event_type, event_id, exp((value - max(value) OVER (PARTITION BY event_type)) / 20) AS x FROM events),
p AS (SELECT event_type, event_id, x / sum(x) OVER (PARTITION BY event_type) AS p FROM e)"""


@query(
    _SOFT
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY p, event_id) AS up, row_number() OVER (PARTITION BY event_type ORDER BY p DESC, event_id) AS down FROM p)
SELECT event_type, count(*) AS n, round(-sum(p * ln(p)), 6) AS entropy, round(-sum(p * ln(p)) / ln(count(*)), 6) AS normalised, round((2 * sum(up * p) / sum(p) - (count(*) + 1)) / count(*), 6) AS gini,
  round(sum(p) FILTER (down <= 1), 6) AS top_1, round(sum(p) FILTER (down <= 5), 6) AS top_5, round(sum(p) FILTER (down <= 10), 6) AS top_10 FROM r GROUP BY 1"""
)
def softmax_entropy(spark, d):
    p = laid_out(A.with_softmax_of_few(table(spark, d, "events").select("event_type", "event_id", "value"), "value", ["event_type"], 20.0))
    out = A.concentration(p, "p", ["event_type"], "event_id")
    return out.select("event_type", "n", *[r6(F.col(c)).alias(c) for c in out.columns if c not in ("event_type", "n")])


@query(
    """WITH m AS (SELECT event_type, event_id, (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w + 1e-8) AS x FROM events WINDOW w AS (PARTITION BY event_type)),
h AS (SELECT event_type, least(CAST(floor(x * 256) AS BIGINT), 255) AS bin, count(*) AS n FROM m GROUP BY 1, 2),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY event_type) AS p, (bin + 0.5) / 256 AS centre FROM h),
o AS (SELECT *, sum(p) OVER u AS omega, sum(p * centre) OVER u AS mu, sum(p * centre) OVER (PARTITION BY event_type) AS total FROM s WINDOW u AS (PARTITION BY event_type ORDER BY bin ROWS UNBOUNDED PRECEDING)),
v AS (SELECT *, round(CASE WHEN omega > 0 AND omega < 1 - 1e-12 THEN pow(total * omega - mu, 2) / (omega * (1 - omega)) ELSE 0 END, 9) AS variance FROM o),
t AS (SELECT event_type, centre AS threshold, variance FROM v QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY variance DESC, bin) = 1)
SELECT event_type, round(threshold, 6) AS threshold, round(variance, 6) AS variance, count(*) FILTER (x > threshold) AS above, round(avg(1 / (1 + exp(-10 * (x - threshold)))), 6) AS soft FROM m JOIN t USING (event_type) GROUP BY 1, 2, 3"""
)
def otsu(spark, d):
    m = A.with_scaled(table(spark, d, "events").select("event_type", "value"), "value", ["event_type"], "x")
    t = A.otsu(m, "x", ["event_type"])
    joined = m.join(t, "event_type")
    out = joined.groupBy("event_type", "threshold", "variance").agg(F.count_if(F.col("x") > F.col("threshold")).alias("above"), r6(F.avg(A.soft_mask(F.col("x"), F.col("threshold"), 10.0))).alias("soft"))
    return out.select("event_type", r6(F.col("threshold")).alias("threshold"), r6(F.col("variance")).alias("variance"), "above", "soft")


def _grid(spark, d):
    """A 24 x 24 map a type: hour by the value's 24th; on where the mean is over 55; two words (even, odd ids)."""
    col = F.least(F.floor(F.col("value") / 100 * 24), F.lit(23)).cast("long")
    return table(spark, d, "events").select("event_type", F.hour("ts").cast("long").alias("row"), col.alias("col"), (F.col("event_id") % 2).alias("word"), "value")


_GRID = "WITH RECURSIVE g AS (SELECT event_type, hour(ts) AS row, least(CAST(floor(value / 100 * 24) AS BIGINT), 23) AS col, event_id % 2 AS word, value FROM events)"


@query(_GRID + " SELECT event_type, row, col, bool_or(value > 55) AS mask, round(max(value), 6) AS map, round(avg(m), 6) AS mean FROM (SELECT *, avg(value) OVER (PARTITION BY event_type, row, col, word) AS m FROM g) GROUP BY 1, 2, 3")
def mask_union(spark, d):
    # a word's mean counts once for each of its rows
    words = _grid(spark, d).groupBy("event_type", "row", "col", "word").agg(F.bool_or(F.col("value") > 55).alias("mask"), F.max("value").alias("map"), F.count("*").alias("rows"), F.avg("value").alias("m"))
    mean = F.sum(F.col("m") * F.col("rows")) / F.sum(F.when(F.col("m").isNotNull(), F.col("rows")))
    return words.groupBy("event_type", "row", "col").agg(F.bool_or("mask").alias("mask"), r6(F.max("map")).alias("map"), r6(mean).alias("mean"))


@query(
    _GRID
    + """, c AS (SELECT event_type, row, col, sum(value) AS mass FROM g GROUP BY 1, 2, 3),
o AS (SELECT i, j, exp(-(i * i + j * j) / 2.0) AS w FROM range(-2, 3) a(i), range(-2, 3) b(j)),
k AS (SELECT event_type, row + i AS row, col + j AS col, sum(mass * w) / sum(w) AS smooth FROM c, o GROUP BY 1, 2, 3),
f AS (SELECT c.*, smooth > avg(smooth) OVER (PARTITION BY event_type) AS lit FROM c JOIN k USING (event_type, row, col)),
n AS (SELECT event_type, row, col, mass FROM f WHERE lit),
reach AS (SELECT event_type, row, col, row AS r, col AS c FROM n UNION
  SELECT reach.event_type, reach.row, reach.col, n.row, n.col FROM reach JOIN n ON n.event_type = reach.event_type AND abs(n.row - reach.r) <= 1 AND abs(n.col - reach.c) <= 1),
own AS (SELECT event_type, row, col, min(r * 1000 + c) AS part FROM reach GROUP BY 1, 2, 3),
m AS (SELECT event_type, part, sum(mass) AS mass FROM own JOIN n USING (event_type, row, col) GROUP BY 1, 2),
p AS (SELECT event_type, mass / sum(mass) OVER (PARTITION BY event_type) AS p FROM m)
SELECT event_type, count(*) AS components, round(-sum(p * ln(p)), 6) AS entropy FROM p GROUP BY 1"""
)
def component_mass(spark, d):
    """Entropy of the masses of a map's connected components, after smoothing."""
    cells = _grid(spark, d).groupBy("event_type", "row", "col").agg(F.sum("value").alias("mass"))
    smooth = A.smoothed(cells, ["event_type"], "row", "col", "mass")
    cut = smooth.groupBy("event_type").agg(F.avg("smooth").alias("cut"))
    grid = smooth.join(cut, "event_type").withColumn("on", F.col("smooth") > F.col("cut"))
    labels = labelled_components(grid, "event_type", "row", "col", "on").join(grid, ["event_type", "row", "col"]).where("component >= 0")
    parts = labels.groupBy("event_type", "component").agg(F.sum("mass").alias("mass"))
    p = F.col("mass") / F.sum("mass").over(Window.partitionBy("event_type"))
    return parts.withColumn("p", p).groupBy("event_type").agg(F.count("*").alias("components"), r6(-F.sum(F.col("p") * F.log("p"))).alias("entropy"))


_TOKENS = """WITH c AS (SELECT user_id, event_type AS token, count(*) AS n, sum(value) / 100 AS logit FROM events GROUP BY 1, 2),
e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY user_id)) AS x FROM c), p AS (SELECT *, x / sum(x) OVER (PARTITION BY user_id) AS p FROM e)"""


def _tokens(spark, d):
    logit = summed("value") / 100
    c = table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("token")).agg(F.count("*").alias("n"), logit.alias("logit"))
    return A.with_softmax(c, "logit", ["user_id"])


@query(
    _TOKENS
    + """SELECT user_id, token, n, rank() OVER (PARTITION BY user_id ORDER BY p DESC) <= 2 AS top_k, coalesce(round(sum(p) OVER (PARTITION BY user_id ORDER BY p DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 9) <= 0.9, true) AS top_p,
  round(sum(p) OVER (PARTITION BY user_id ORDER BY p, token DESC ROWS UNBOUNDED PRECEDING), 9) > 0.1 AS top_p_up, round(CASE WHEN logit > 0 THEN logit / 1.2 ELSE logit * 1.2 END - 0.1 * n - 0.5, 6) AS penalised FROM p"""
)
def nucleus(spark, d):
    t, by = _tokens(spark, d), ["user_id"]
    return t.select(
        "user_id", "token", "n", A.top_k_kept("p", by, 2).alias("top_k"), A.nucleus_kept("p", by, "token", 0.9).alias("top_p"), A.nucleus_kept_ascending("p", by, "token", 0.9).alias("top_p_up"), r6(A.penalised(F.col("logit"), F.col("n"), 1.2, 0.1, 0.5)).alias("penalised")
    )


@query(_TOKENS + " SELECT user_id, token, p >= 0.2 * max(p) OVER (PARTITION BY user_id) AS kept FROM p")
def min_p(spark, d):
    return _tokens(spark, d).select("user_id", "token", A.min_p_kept("p", ["user_id"], 0.2).alias("kept"))


@query(_TOKENS + " SELECT user_id, token, rank() OVER (PARTITION BY user_id ORDER BY n DESC) AS place, rank() OVER (PARTITION BY user_id ORDER BY n DESC) <= 1 AS top_1 FROM c")
def rank_of(spark, d):
    """1 + how many tokens are strictly more frequent."""
    place = F.rank().over(Window.partitionBy("user_id").orderBy(F.desc("n"))).cast("long")
    return _tokens(spark, d).select("user_id", "token", place.alias("place"), (place <= 1).alias("top_1"))


@query(
    """WITH b AS (SELECT user_id % 10 AS grp, user_id AS parent, event_type AS token, round(ln(count(*) + 1.0), 9) AS logp FROM events GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY grp ORDER BY logp DESC, parent, token) AS place FROM b QUALIFY place <= 6"""
)
def beam_top(spark, d):
    b = table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("grp"), F.col("user_id").alias("parent"), F.col("event_type").alias("token")).agg(F.round(F.log(F.count("*") + 1.0), 9).alias("logp"))
    return A.beam_step(b, ["grp"], 3)


@query(
    """WITH e AS (SELECT event_id // 2 AS pair, max(value) FILTER (event_id % 2 = 0) AS c, max(value) FILTER (event_id % 2 = 1) AS u, min(ts) AS ts FROM events GROUP BY 1)
SELECT pair, round(u + 5 * (c - u), 6) AS blended, round(least(greatest((u + 5 * (c - u) - 50) / 50, -1), 1) * 127.5 + 127.5, 6) AS pixel,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN date_part('microsecond', ts) % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(date_part('microsecond', ts) % 1000000 AS VARCHAR), 6, '0') END AS at FROM e"""
)
def blend_and_clip(spark, d):
    """Guidance: odd rows are unconditional, even ones conditional."""
    even = F.col("event_id") % 2 == 0
    e = table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 2).alias("pair")).agg(F.max(F.when(even, F.col("value"))).alias("c"), F.max(F.when(~even, F.col("value"))).alias("u"), F.min("ts").alias("ts"))
    blended = F.col("u") + 5 * (F.col("c") - F.col("u"))
    pixel = F.least(F.greatest((blended - 50) / 50, F.lit(-1.0)), F.lit(1.0)) * 127.5 + 127.5
    # greatest and least skip nulls: a pair without its partner has no pixel
    return e.select("pair", r6(blended).alias("blended"), r6(F.when(blended.isNotNull(), pixel).otherwise(F.lit(0.0))).alias("pixel"), X.iso_time(F.col("ts")).alias("at"))
