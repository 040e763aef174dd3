"""Queries that look values up: scores, categories, labels, nearest rows, required fields; and a loop fed by its own output."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import curate as C
from tessera.operators import evaluate as E
from tessera.operators import pivots as P
from tessera.operators import vectors as V
from tessera.operators.common import laid_out, r6, running_number, shared_folder
from tessera.plans.registry import query, table
from tessera.plans.vectors import _L2, _RADII, _radii, _sided, _vectors
from tessera.streaming import durable


@query("SELECT lang, count(*) AS n, round(avg(coalesce(quality, 0)), 6) AS mean FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def lookup_mean(spark, d):
    """The mean of a score that is looked up; a document without one counts 0."""
    docs, labels = table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").select("doc_id", "quality")
    return E.with_default(docs, labels, "doc_id", "quality", 0).groupBy("lang").agg(F.count("*").alias("n"), r6(F.avg("quality")).alias("mean"))


@query(
    """WITH t AS (SELECT *, row_number() OVER w AS r, first_value(role) OVER w AS opens FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM t WHERE r > 1 OR opens = 'user'"""
)
def leading_turns(spark, d):
    """Turns of conversations, without a first one that is not the user's."""
    return C.without_leading(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], F.col("role") == "user", "place")


@query(
    """SELECT o_orderpriority AS category, count(*) AS answers, count(*) FILTER (l_returnflag = 'R') AS yes, round(avg(l_quantity), 6) AS mean
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND l_linestatus = 'O' GROUP BY 1"""
)
def category_answers(spark, d):
    """Answers of one type whose question has one of the categories: the category is looked up, the type is the answer's own."""
    lines = table(spark, d, "lineitem").where("l_linestatus = 'O'").select("l_orderkey", "l_returnflag", "l_quantity")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("category"))
    kept = C.of_categories(lines, orders, "l_orderkey", "category", ["1-URGENT", "5-LOW"])
    return kept.groupBy("category").agg(F.count("*").alias("answers"), F.count_if(F.col("l_returnflag") == "R").alias("yes"), r6(F.avg("l_quantity")).alias("mean"))


@query(
    """WITH s AS (SELECT user_id, event_type AS class, sum(value) AS score FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 6) DESC, class) AS place FROM s),
t AS (SELECT user_id, arg_max(event_type, struct_pack(ts, event_id)) AS class FROM events GROUP BY 1)
SELECT count(*) AS n, round(avg(CAST(coalesce(place <= 1, false) AS INT)), 6) AS top_1, round(avg(CAST(coalesce(place <= 3, false) AS INT)), 6) AS top_3 FROM t LEFT JOIN r USING (user_id, class)"""
)
def top_hits(spark, d):
    """Is a user's latest type among the one or three types with the largest sums?"""
    events = table(spark, d, "events")
    scores = events.groupBy("user_id", F.col("event_type").alias("class")).agg(F.round(F.sum("value"), 6).alias("score"))
    truth = events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("class"))
    hits = E.top_hits(scores, truth, "user_id", "class", "score", (1, 3))
    return hits.agg(F.count("*").alias("n"), *[r6(F.avg(F.col(c).cast("int"))).alias(c) for c in ("top_1", "top_3")])


@query(
    _RADII
    + f""", m AS (SELECT a.vec_id AS id, max(radius / ({_L2} + 1e-6)) AS realism, arg_min(b.vec_id, struct_pack(d := round({_L2}, 9), i := b.vec_id)) AS nearest
FROM embeddings a JOIN embeddings b ON a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 JOIN k ON k.id = b.vec_id GROUP BY 1) SELECT id, round(realism, 5) AS realism, nearest FROM m"""
)
def realism_nearest(spark, d):
    """Of each even vector the largest ratio of an odd one's radius to their distance, and the nearest odd one."""
    v, radii = _vectors(spark, d), laid_out(_radii(_sided(spark, d, (1,))))
    odd = v.where("vec_id % 2 = 1").join(radii.select(F.col("id").alias("vec_id"), "radius"), "vec_id")
    ix, even = P.index(odd, "vec_id", "embedding", "radius"), v.where("vec_id % 2 = 0")
    near = P.nearest(ix, even, "vec_id", "embedding", 1)[0].select("query", F.col("id").alias("nearest"))
    return P.within(ix, even, "vec_id", "embedding").join(near, "query").select(F.col("query").alias("id"), F.round("realism", 5).alias("realism"), "nearest")


@query(
    """WITH p AS (SELECT "label", i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2),
b AS (SELECT "label" AS code, list(x ORDER BY i) AS m FROM p GROUP BY 1),
v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v),
w AS (SELECT code, list_transform(m, lambda x: x / sqrt(list_inner_product(m, m))) AS m FROM b),
s AS (SELECT 'plain' AS form, vec_id, code, round(list_inner_product(e, e) + list_inner_product(m, m) - 2 * list_inner_product(e, m), 9) AS d FROM v, b
UNION ALL SELECT 'unit', vec_id, code, round(list_inner_product(e, e) + list_inner_product(m, m) - 2 * list_inner_product(e, m), 9) FROM u, w),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY form, vec_id ORDER BY d, code) = 1)
SELECT form, code, count(*) AS n, round(avg(d), 6) AS distance FROM best GROUP BY 1, 2"""
)
def l2_codebook(spark, d):
    """Vectors by the nearest centroid by squared distance, as they are and as unit vectors."""
    v = _vectors(spark, d)
    book = laid_out(V.centroids(v, "label", "embedding", unit=False).withColumnRenamed("label", "code"))
    out = None
    for form in ("plain", "unit"):
        near = V.assigned(v, book, "code", "embedding", "l2" if form == "plain" else "unit l2")
        rows = near.groupBy("code").agg(F.count("*").alias("n"), r6(-F.avg("score")).alias("distance")).withColumn("form", F.lit(form))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    """WITH p AS (SELECT client_id, max(value) FILTER (kind = 'view') AS txt, max(value) FILTER (kind = 'signup') AS png, max(value) FILTER (kind = 'purchase') AS jpg FROM clicks GROUP BY 1)
SELECT client_id, round(txt, 6) AS caption, round(coalesce(png, jpg), 6) AS image FROM p WHERE txt IS NOT NULL AND coalesce(png, jpg) IS NOT NULL"""
)
def captioned(spark, d):
    """Samples with a caption and with an image in any of its forms, the first of them."""
    one = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("value")))
    parts = table(spark, d, "clicks").groupBy("client_id").agg(one("view").alias("txt"), one("signup").alias("png"), one("purchase").alias("jpg"))
    return C.with_caption_and_image(parts, "txt", ["png", "jpg"]).select("client_id", r6(F.col("txt")).alias("caption"), r6(F.col("image")).alias("image"))


@query(
    """SELECT client_id, concat_ws(',', CASE WHEN name IS NULL OR trim(name) = '' THEN 'name' END, CASE WHEN email IS NULL OR trim(email) = '' THEN 'email' END, CASE WHEN city IS NULL OR trim(city) = '' THEN 'city' END,
  CASE WHEN balance IS NULL THEN 'balance' END) AS missing, name IS NOT NULL AND trim(name) <> '' AND email IS NOT NULL AND trim(email) <> '' AND city IS NOT NULL AND trim(city) <> '' AND balance IS NOT NULL AS complete FROM clients"""
)
def required_fields(spark, d):
    """Which of the required fields a record lacks; blank texts are lacking."""
    missing = C.missing_fields(table(spark, d, "clients"), ["name", "email", "city", "balance"])
    return table(spark, d, "clients").select("client_id", F.array_join(missing, ",").alias("missing"), (F.size(missing) == 0).alias("complete"))


@query("SELECT click_id, client_id, ts, row_number() OVER (ORDER BY client_id NULLS FIRST, ts NULLS FIRST, click_id NULLS FIRST) AS place FROM clicks")
def request_order(spark, d):
    """Outputs by the id of their request, which a third of them may share, then by time; with their place."""
    return running_number(table(spark, d, "clicks").select("click_id", "client_id", "ts"), ["client_id", "ts", "click_id"], "place", 1)


@query(
    """SELECT p_type AS word, p_partkey % 8 AS round, p_partkey AS id FROM part QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY p_partkey % 8, p_partkey) = 1
ORDER BY p_partkey % 8, p_partkey LIMIT 100"""
)
def feedback_loop(spark, d):
    """Rounds offer the parts of one residue each, until a hundred distinct types are in the journal."""
    part = table(spark, d, "part").select(F.col("p_type").alias("word"), (F.col("p_partkey") % 8).alias("round"), F.col("p_partkey").cast("long").alias("id"))
    journal = durable.Journal(spark, f"{shared_folder(spark)}/tables/loop-{uuid.uuid4().hex}", part.schema)
    durable.feedback(journal, lambda k, _: part.where(F.col("round") == k), ["word"], ["round", "id"], 100, 8)
    return journal.read()
