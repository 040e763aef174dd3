"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import evaluate as E
from tessera.operators.common import running_number, top_k
from tessera.operators.selection import quantile
from tessera.plans.registry import query, table


@query("SELECT doc_id, lang, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def left_default(spark, d):
    return E.with_default(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id", "quality", -1, "toxic")


@query(
    """SELECT o_orderkey, c_name, coalesce(n_name, 'MISSING') AS nation, coalesce(r_name, 'FAILED') AS region, coalesce(lines, 0) AS lines
FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20
LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT l_orderkey, count(*) AS lines FROM lineitem WHERE l_discount > 0.05 GROUP BY 1) ON l_orderkey = o_orderkey"""
)
def chain_join(spark, d):
    lines = table(spark, d, "lineitem").where("l_discount > 0.05").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    customer = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey"))
    nation = table(spark, d, "nation").where("n_nationkey < 20").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    out = orders.join(customer, "c_custkey").join(nation, "n_nationkey", "left").join(table(spark, d, "region"), "r_regionkey", "left").join(lines, "o_orderkey", "left")
    return out.select("o_orderkey", "c_name", F.coalesce("n_name", F.lit("MISSING")).alias("nation"), F.coalesce("r_name", F.lit("FAILED")).alias("region"), F.coalesce("lines", F.lit(0)).alias("lines"))


@query(
    r"""SELECT page_id, doc_id, lower(lang) AS lang, 'COCO_val2014_' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.jpg' AS file_name
FROM pages JOIN documents ON doc_id = CAST(nullif(regexp_extract(url, '([0-9]+)[^0-9]*$', 1), '') AS BIGINT) AND lower(lang) IN ('en', 'de')"""
)
def computed_key_join(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "([0-9]+)[^0-9]*$", 1).try_cast("long").alias("doc_id"))
    docs = table(spark, d, "documents").select("doc_id", F.lower("lang").alias("lang")).where(F.col("lang").isin("en", "de"))
    return pages.join(docs, "doc_id").select("page_id", "doc_id", "lang", F.format_string("COCO_val2014_%012d.jpg", "doc_id").alias("file_name"))


@query(
    """SELECT item_id, doc_id FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) AS i FROM benchmark)
JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM documents) USING (i)"""
)
def positional_zip(spark, d):
    return E.zipped(table(spark, d, "benchmark").select("item_id"), "item_id", table(spark, d, "documents").select("doc_id"), "doc_id")


@query(
    """SELECT p_partkey, CASE WHEN contains(lower(p_name), 'green') THEN 'green' WHEN contains(lower(p_name), 'red') THEN 'red' WHEN contains(lower(p_name), 'a') THEN 'a' END AS phrase,
  contains(p_name, 'a') AND contains(p_name, 'e') AS all_of FROM part"""
)
def substring_join(spark, d):
    name = F.lower("p_name")
    phrase = F.coalesce(*[F.when(F.contains(name, F.lit(w)), F.lit(w)) for w in ("green", "red", "a")])
    both = F.contains("p_name", F.lit("a")) & F.contains("p_name", F.lit("e"))
    return table(spark, d, "part").select("p_partkey", phrase.alias("phrase"), both.alias("all_of"))


_CONF = """count(*) FILTER (p AND q) AS tp, count(*) FILTER (p AND NOT q) AS fp, count(*) FILTER (NOT p AND NOT q) AS tn, count(*) FILTER (NOT p AND q) AS fn"""


@query(
    f"""WITH c AS (SELECT lang, {_CONF} FROM (SELECT lang, n_chars > 1000 AS p, quality = 1 AS q FROM documents JOIN labels USING (doc_id)) GROUP BY 1),
r AS (SELECT *, tp / nullif(tp + fp, 0) AS pr, tp / nullif(tp + fn, 0) AS re FROM c)
SELECT lang, tp, fp, tn, fn, round(pr, 6) AS precision, round(re, 6) AS recall, round(2 * pr * re / nullif(pr + re, 0), 6) AS f1,
  round((tp + tn) / nullif(tp + fp + tn + fn, 0), 6) AS accuracy, round((tp + fp) / nullif(tp + fp + tn + fn, 0), 6) AS yes_ratio FROM r"""
)
def confusion(spark, d):
    joined = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return E.ratios(joined.groupBy("lang").agg(*E.confusion(F.col("n_chars") > 1000, F.col("quality") == 1)))


@query(
    """SELECT coalesce(source, 'total') AS source, count(*) AS n, count(*) FILTER (quality = 1) AS correct, round(avg(quality), 6) AS accuracy,
  round(avg(quality) FILTER (toxic = 0), 6) AS clean_accuracy, count(*) FILTER (lang = 'en' AND quality = 1) AS english,
  round(coalesce(count(*) FILTER (quality = 1 AND toxic = 1) / nullif(count(*) FILTER (toxic = 1), 0), 0), 6) AS toxic_accuracy
FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (source)"""
)
def accuracy_rollup(spark, d):
    joined = table(spark, d, "documents").select("doc_id", "source", "lang").join(table(spark, d, "labels"), "doc_id")
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    return E.with_total(
        joined,
        "source",
        "total",
        [
            F.count("*").alias("n"),
            F.count_if(good).alias("correct"),
            F.round(F.avg("quality"), 6).alias("accuracy"),
            F.round(F.avg(F.when(~toxic, F.col("quality"))), 6).alias("clean_accuracy"),
            F.count_if((F.col("lang") == "en") & good).alias("english"),
            F.round(F.coalesce(F.try_divide(F.count_if(good & toxic), F.count_if(toxic)), F.lit(0.0)), 6).alias("toxic_accuracy"),
        ],
    )


@query(
    """WITH m AS (SELECT coalesce(event_type, 'all') AS event_type, round(avg(value) FILTER (event_id % 2 = 0), 3) AS m0, round(avg(value) FILTER (event_id % 2 = 1), 3) AS m1
  FROM events GROUP BY ROLLUP (event_type)) SELECT event_type, m0, m1, round(m1 / nullif(m0, 0) * 100, 1) AS ratio FROM m"""
)
def ratio_of_means(spark, d):
    even = F.col("event_id") % 2 == 0
    means = E.with_total(
        table(spark, d, "events"), "event_type", "all", [F.round(F.avg(F.when(even, F.col("value"))), 3).alias("m0"), F.round(F.avg(F.when(~even, F.col("value"))), 3).alias("m1")]
    )
    return means.withColumn("ratio", F.round(F.try_divide(F.col("m1"), F.col("m0")) * 100, 1))


@query(
    """WITH t AS (SELECT event_id, value, unnest([event_type, 'user' || (user_id % 3)]) AS tag FROM events WHERE value > 20)
SELECT tag, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM t GROUP BY 1
UNION ALL SELECT 'all', count(*), round(avg(value), 6), round(stddev_samp(value), 6) FROM (SELECT DISTINCT event_id, value FROM t)"""
)
def tag_stats(spark, d):
    events = table(spark, d, "events").where("value > 20")
    return E.tag_stats(events, F.array("event_type", F.concat(F.lit("user"), F.col("user_id") % 3)), "value", "event_id")


@query(
    """WITH v AS (SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 10),
c AS (SELECT user_id, event_type, count(*) AS c, sum(count(*)) OVER (PARTITION BY user_id) AS total FROM v GROUP BY 1, 2),
s AS (SELECT user_id, event_type, c, (c * least(1.0, (c - 1) / 3.0) + (10 - c) * least(1.0, c / 3.0)) / 10 AS score FROM c WHERE total = 10)
SELECT user_id, event_type, c AS matches, round(score, 6) AS score, event_type IN ('click', 'view') AS exact, round(avg(score) OVER (PARTITION BY user_id), 6) AS mean FROM s"""
)
def soft_vote(spark, d):
    votes = top_k(table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id"], ["event_id"], 10)
    counts = votes.groupBy("user_id", "event_type").agg(F.count("*").alias("matches"))
    user = Window.partitionBy("user_id")
    scored = counts.withColumn("total", F.sum("matches").over(user)).where("total = 10").withColumn("score", E.vote_score(F.col("matches")))
    exact = F.array_contains(F.array(F.lit("click"), F.lit("view")), F.col("event_type"))
    return scored.select("user_id", "event_type", "matches", F.round("score", 6).alias("score"), exact.alias("exact"), F.round(F.avg("score").over(user), 6).alias("mean"))


_T = ["Brand#12", "Brand#23", ""]


@query(
    """SELECT p_partkey, round(list_max(list_transform(['Brand#12', 'Brand#23', ''], lambda t: CASE WHEN greatest(length(p_brand), length(t)) = 0 THEN 1.0
  WHEN 1 - levenshtein(p_brand, t) / greatest(length(p_brand), length(t)) < 0.5 THEN 0.0 ELSE 1 - levenshtein(p_brand, t) / greatest(length(p_brand), length(t)) END)), 6) AS anls FROM part"""
)
def anls(spark, d):
    truths = F.array(*[F.lit(t) for t in _T])
    return table(spark, d, "part").select("p_partkey", F.round(E.anls(F.col("p_brand"), truths), 6).alias("anls"))


@query(
    """SELECT l_orderkey, round(product(1 - l_discount), 10) AS reward, round(avg(round(1 - l_discount, 4)), 8) AS mean FROM lineitem GROUP BY 1"""
)
def product_reward(spark, d):
    x = 1 - F.col("l_discount")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(E.product_of(x), 10).alias("reward"), F.round(F.avg(F.round(x, 4)), 8).alias("mean"))


@query(
    """WITH s AS (SELECT user_id, avg(value) FILTER (event_type = 'click') AS s, avg(value) FILTER (event_type = 'view') AS a, avg(value) FILTER (event_type = 'purchase') AS c FROM events GROUP BY 1),
m AS (SELECT user_id, CASE WHEN user_id % 5 = 0 THEN (s + a) / 2 WHEN user_id % 3 = 0 THEN (c + a) / 2 ELSE (s + a + c) / 3 END AS score FROM s),
u AS (SELECT user_id, score, 0 AS p FROM m UNION ALL SELECT user_id, -1.0, 1 FROM m WHERE user_id % 7 = 0)
SELECT user_id, round(score, 6) AS score FROM u QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY p DESC) = 1"""
)
def composite_score(spark, d):
    one = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("value")))
    s = table(spark, d, "events").groupBy("user_id").agg(one("click").alias("s"), one("view").alias("a"), one("purchase").alias("c"))
    score = E.case_composite(F.col("user_id") % 5 == 0, F.col("user_id") % 3 == 0, F.col("s"), F.col("a"), F.col("c"))
    first = s.select("user_id", score.alias("score"))
    return E.prioritised([first, first.where("user_id % 7 = 0").withColumn("score", F.lit(-1.0))], "user_id").select("user_id", F.round("score", 6).alias("score"))


@query(
    """SELECT 'type' AS level, event_type AS name, count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(count(*) FILTER (value > 50) / nullif(count(*), 0), 0), 6) AS share,
  round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 2
UNION ALL SELECT 'all', 'all', count(*), round(avg(value), 6), round(coalesce(count(*) FILTER (value > 50) / nullif(count(*), 0), 0), 6), round(quantile_cont(value, 0.95), 6) FROM events
UNION ALL SELECT 'class', CAST(quality AS VARCHAR), count(*), 0, 0, 0 FROM labels GROUP BY 2 HAVING count(*) >= 10"""
)
def means_guarded(spark, d):
    share = F.coalesce(F.try_divide(F.count_if(F.col("value") > 50), F.count("*")), F.lit(0.0))
    stats = [F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(share, 6).alias("share")]
    events = table(spark, d, "events").select(F.col("event_type").alias("name"), "value")
    p95 = F.round("quantile", 6).alias("p95")
    tails = quantile(events, "value", 0.95, "name").select(F.col("name").alias("of"), p95)
    by = events.groupBy("name").agg(*stats).withColumn("level", F.lit("type")).join(tails, F.col("name").eqNullSafe(F.col("of")), "left").drop("of")
    whole = events.agg(*stats).withColumns({"level": F.lit("all"), "name": F.lit("all")}).join(quantile(events, "value", 0.95).select(p95), how="left")
    zero = F.lit(0.0)
    classes = table(spark, d, "labels").groupBy(F.col("quality").cast("string").alias("name")).agg(F.count("*").alias("n")).where("n >= 10").withColumns({"mean": zero, "share": zero, "p95": zero, "level": F.lit("class")})
    return by.unionByName(whole).unionByName(classes)


@query(
    r"""SELECT c_custkey, regexp_extract(c_name, '_([0-9]+)', 1) AS tail, row_number() OVER (ORDER BY CAST(nullif(regexp_extract(c_name, '([0-9]+)', 1), '') AS BIGINT), c_custkey) AS place,
  row_number() OVER (ORDER BY regexp_replace(c_name, '[0-9]+', '', 'g'), lpad(regexp_extract(c_name, '([0-9]+)', 1), 20, '0'), c_custkey) AS natural FROM customer"""
)
def natural_sort(spark, d):
    digits = F.regexp_extract("c_name", "([0-9]+)", 1)
    rows = table(spark, d, "customer").select("c_custkey", "c_name", F.regexp_extract("c_name", "_([0-9]+)", 1).alias("tail"))
    rows = running_number(rows, [digits.try_cast("long"), "c_custkey"], "place", 1)
    rows = running_number(rows, [F.regexp_replace("c_name", "[0-9]+", ""), F.lpad(digits, 20, "0"), "c_custkey"], "natural", 1)
    return rows.drop("c_name")


@query(
    """SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 5000 THEN 'rich' END, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END, c_name) AS image,
  c_name IS NULL OR lower(c_name) IN ('nan', 'none') AS missing, CASE WHEN c_acctbal < 0 THEN 1 WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 3 END AS n_options FROM customer"""
)
def first_available(spark, d):
    image = F.coalesce(F.when(F.col("c_acctbal") > 5000, "rich"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")), F.col("c_name"))
    missing = F.col("c_name").isNull() | F.lower("c_name").isin("nan", "none")
    options = F.array("c_name", F.when(F.col("c_acctbal") >= 0, F.lit("b")), F.when(F.col("c_mktsegment") != "BUILDING", F.lit("c")))
    stop = F.array_position(F.transform(options, lambda x: x.isNull()), True)  # options up to the first that is missing
    taken = F.when(stop > 0, F.slice(options, F.lit(1), (stop - 1).cast("int"))).otherwise(options)
    return table(spark, d, "customer").select("c_custkey", image.alias("image"), missing.alias("missing"), F.size(taken).alias("n_options"))
