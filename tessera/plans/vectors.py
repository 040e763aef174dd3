"""Queries over embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import pivots as P
from tessera.operators import vectors as V
from tessera.operators.common import laid_out, running_number
from tessera.operators.selection import quantile
from tessera.plans.registry import query, table

_FRAME_BLOCK = 65_536
_COS = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"
_L2 = "list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))


@query(
    f"""SELECT a.vec_id AS query, b.vec_id AS id, round({_COS}, 6) AS cosine, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 10 = 0 QUALIFY rank <= 5"""
)
def similarity_topk(spark, d):
    v = _vectors(spark, d)
    return V.nearest(v, v.where("vec_id % 10 = 0"), 5, "vec_id", "embedding").select("query", "id", F.round("measure", 6).alias("cosine"), "rank")


_BOOK = """WITH u AS (SELECT vec_id, "label", embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
p AS (SELECT "label", i, avg(e[i] / n) AS x FROM u, range(1, 65) t(i) GROUP BY 1, 2),
c AS (SELECT "label" AS code, list(x ORDER BY i) AS m FROM p GROUP BY 1),
b AS (SELECT code, m, sqrt(list_inner_product(m, m)) AS mn FROM c),
s AS (SELECT vec_id, code, round(list_inner_product(e, m) / (n * mn), 9) AS score FROM u, b),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, code) = 1)
"""


@query(
    _BOOK
    + """SELECT code, count(vec_id) AS n, round(count(vec_id) / sum(count(vec_id)) OVER (), 6) AS share, count(vec_id) / sum(count(vec_id)) OVER () > 0.01 / count(*) OVER () AS used, round(avg(score), 6) AS score
FROM b LEFT JOIN best USING (code) GROUP BY 1"""
)
def nn_codebook(spark, d):
    v = _vectors(spark, d)
    book = laid_out(V.centroids(v, "label", "embedding").withColumnRenamed("label", "code"))
    near = V.assigned(v, book, "code", "embedding").groupBy("code").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("score"))
    every = Window.partitionBy(F.lit(0))  # a row a code
    codes = book.select("code").join(near, "code", "left").withColumns({"total": F.sum("n").over(every), "size": F.count("*").over(every)})
    share = F.coalesce("n", F.lit(0)) / F.col("total")
    return codes.select("code", F.coalesce("n", F.lit(0)).alias("n"), F.round(share, 6).alias("share"), (share > 0.01 / F.col("size")).alias("used"), "score")


_RADII = f"""WITH d AS (SELECT a.vec_id AS id, {_L2} AS d2, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_L2}, b.vec_id) AS r
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.vec_id % 2 = b.vec_id % 2),
k AS (SELECT id, d2 AS radius FROM d WHERE r = 3)"""


@query(_RADII + " SELECT id, round(radius, 6) AS radius, round(CASE WHEN radius > quantile_cont(radius, 0.9) OVER (PARTITION BY id % 2) THEN 0 ELSE radius END, 6) AS clamped FROM k")
def knn_radius(spark, d):
    radii = laid_out(_radii(_sided(spark, d, (-1, 0, 1))))
    cut = quantile(radii, "radius", 0.9, "side").withColumnRenamed("quantile", "cut")
    clamped = F.when(F.col("radius") > F.col("cut"), 0.0).otherwise(F.col("radius"))
    return radii.join(F.broadcast(cut), "side").select("id", F.round("radius", 6).alias("radius"), F.round(clamped, 6).alias("clamped"))


def _sided(spark, d, sides):
    """An index whose sides are the remainders of ids by 2; that of a negative odd id is -1."""
    left = F.col("vec_id") % 2
    return P.index(_vectors(spark, d).where(left.isin(*sides)), "vec_id", "embedding", side=left + 1)


def _radii(ix):
    """Squared distance to the third neighbour on the own side (even or odd ids)."""
    near = P.nearest(ix, None, "vec_id", "embedding", 3)[0].where("rank = 3")
    return near.select(F.col("query").alias("id"), F.col("measure").alias("radius"), (F.col("query") % 2).alias("side"))


@query(
    _RADII
    + f""", m AS (SELECT a.vec_id AS id, bool_or({_L2} <= radius + 1e-12) AS hit, max(radius / ({_L2} + 1e-6)) AS realism FROM embeddings a JOIN embeddings b ON a.vec_id % 2 <> b.vec_id % 2 JOIN k ON k.id = b.vec_id GROUP BY 1)
SELECT CASE WHEN id % 2 = 0 THEN 'precision' ELSE 'recall' END AS name, round(avg(CAST(hit AS INT)), 6) AS value, round(max(realism), 4) AS realism FROM m GROUP BY 1"""
)
def manifold_pr(spark, d):
    """Share of even vectors within the odd ones' manifold (precision), and the other way round (recall)."""
    ix = _sided(spark, d, (-1, 0, 1))
    per = P.within(P.limited(ix, _radii(ix), "id", "radius"), None, "vec_id", "embedding", ix)
    name = F.when(F.col("query") % 2 == 0, "precision").otherwise("recall").alias("name")
    return per.groupBy(name).agg(F.round(F.avg(F.col("hit").cast("int")), 6).alias("value"), F.round(F.max("realism"), 4).alias("realism"))


@query()
def fid(spark, d):
    v = _vectors(spark, d)
    a, b = (V.moments(v.where(F.col("vec_id") % 2 == side), "embedding") for side in (0, 1))
    return spark.createDataFrame([(a[0], b[0], round(V.frechet(*a[1:], *b[1:]), 6))], "n_even long, n_odd long, distance double")


@query(
    """WITH e AS (SELECT vec_id, vec_id // 250 AS split, i, exp(embedding[i]::DOUBLE * 10) AS x FROM embeddings, range(1, 65) t(i)),
p AS (SELECT vec_id, split, i, x / sum(x) OVER (PARTITION BY vec_id) AS p FROM e),
k AS (SELECT vec_id, split, p * (ln(p) - ln(avg(p) OVER (PARTITION BY split, i))) AS kl FROM p),
s AS (SELECT split, vec_id, sum(kl) AS kl FROM k GROUP BY 1, 2) SELECT split, round(exp(avg(kl)), 6) AS score FROM s GROUP BY 1"""
)
def inception_score(spark, d):
    """Splits of 250 by id; all components, scaled and through a softmax, are the class probabilities."""
    x = F.transform("embedding", lambda c: F.exp(c.cast("double") * 10))
    total = F.aggregate("x", F.lit(0.0), lambda s, c: s + c)
    rows = _vectors(spark, d).select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 250).alias("split"), x.alias("x"))
    rows = rows.select("id", "split", F.transform("x", lambda c: c / total).alias("p"))
    return V.inception(rows, "p", "split").select("split", F.round("score", 6).alias("score"))


@query(
    """WITH s AS (SELECT vec_id, "label", sum(embedding[i]::DOUBLE * embedding[i]) AS n2 FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2),
l AS (SELECT "label" AS code, count(*) AS n FROM embeddings GROUP BY 1),
r AS (SELECT vec_id, len(list_distinct(list("label") OVER (ORDER BY vec_id ROWS BETWEEN 63 PRECEDING AND CURRENT ROW))) AS used FROM embeddings)
SELECT s.vec_id, l.code, l.n, r.used, round(greatest(log10(greatest(sqrt(n2) / l.n, 1e-10)), -10), 6) AS magnitude FROM s JOIN l ON s."label" = l.code JOIN r USING (vec_id)"""
)
def code_usage(spark, d):
    """Distinct codes among the last 64 vectors, and the log10 magnitude floored at -10."""
    v = _vectors(spark, d)
    # blocks of running numbers, each with the 63 rows before it
    rows = running_number(v.select("vec_id", "label", V.norm(F.col("embedding")).alias("size")), ["vec_id"])
    own = F.floor(F.col("ord") / _FRAME_BLOCK)
    carried = F.when(F.col("ord") % _FRAME_BLOCK >= _FRAME_BLOCK - 63, F.array(own, own + 1)).otherwise(F.array(own))
    w = Window.partitionBy("block").orderBy("ord").rowsBetween(-63, 0)
    framed = rows.withColumn("block", F.explode(carried)).withColumn("used", F.size(F.array_distinct(F.collect_list("label").over(w))).cast("long"))
    framed = framed.where(F.col("block") == own)
    counts = v.groupBy("label").agg(F.count("*").alias("n"))
    m = F.col("size") / F.col("n")
    return framed.join(counts, "label").select("vec_id", F.col("label").alias("code"), "n", "used", F.round(F.when(m > 1e-9, F.log10(m)).otherwise(-10.0), 6).alias("magnitude"))
