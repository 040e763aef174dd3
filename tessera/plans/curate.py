"""Curation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import curate as C
from tessera.operators.common import running_number
from tessera.operators.selection import weighted_draws
from tessera.plans.registry import query, table

ALLOWED, DISALLOWED = ["the", "that"], ["and"]


@query(
    r"""WITH w AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[a-zA-Z]+') AS w FROM documents)
SELECT doc_id, CASE WHEN list_contains(w, 'and') THEN 'disallowed' WHEN NOT (list_contains(w, 'the') OR list_contains(w, 'that')) THEN 'missing' ELSE 'keep' END AS verdict,
  NOT list_contains(w, 'and') AS weak, lang <> 'en' OR NOT list_contains(w, 'and') AS restricted FROM w"""
)
def word_verdict(spark, d):
    docs = table(spark, d, "documents")
    text = F.col("text")
    weak = C.no_disallowed(text, DISALLOWED)
    return docs.select("doc_id", C.word_verdict(text, ALLOWED, DISALLOWED).alias("verdict"), weak.alias("weak"), ((F.col("lang") != "en") | weak).alias("restricted"))


@query(
    """SELECT doc_id, lang, CASE lang WHEN 'de' THEN '0' WHEN 'en' THEN '1' WHEN 'es' THEN '2' ELSE '3' END ||
  lpad(CAST(n - 1 AS VARCHAR), 6, '0') AS item_id, lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') || '.png' AS file_name
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents) WHERE n <= 200"""
)
def item_ids(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    prefix = F.create_map(*[F.lit(x) for kv in {"de": "0", "en": "1", "es": "2"}.items() for x in kv])
    ids = C.running_ids(docs, F.coalesce(prefix[F.col("lang")], F.lit("3")), ["lang"], ["doc_id"], cap=200)
    return ids.select("doc_id", "lang", "item_id", F.concat(F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0"), F.lit(".png")).alias("file_name"))


@query(
    """SELECT p_partkey, CASE WHEN p_type IN (SELECT min(p_type) FROM part) THEN 'replace,replace,replace'
  WHEN p_size < 20 THEN 'replace,drop,replace' ELSE 'replace,swap,drop' END AS methods, 'T2I' AS task_id FROM part"""
)
def rule_columns(spark, d):
    part = table(spark, d, "part")
    first = part.agg(F.min("p_type").alias("first"))
    rules = [
        (F.col("p_type") == F.col("first"), F.array(*map(F.lit, ["replace", "replace", "replace"]))),
        (F.col("p_size") < 20, F.array(*map(F.lit, ["replace", "drop", "replace"]))),
        (F.col("p_size") >= 20, F.array(*map(F.lit, ["replace", "swap", "drop"]))),
    ]
    methods = C.rule_column(F.col("p_type"), rules)
    return part.join(F.broadcast(first)).select("p_partkey", F.array_join(methods, ",").alias("methods"), F.lit("T2I").alias("task_id"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN 'a' ELSE 'b' END AS origin FROM documents")
def gather_dedup(spark, d):
    """Two inputs that overlap and together hold all rows."""
    docs = table(spark, d, "documents").select("doc_id")
    a, b = docs.where("doc_id % 3 < 2").withColumn("origin", F.lit("a")), docs.where("doc_id % 3 <> 0 OR doc_id IS NULL").withColumn("origin", F.lit("b"))
    return C.sorted_by_number(C.union_first([a, b], "doc_id"), "doc_id")


@query("SELECT doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 ORDER BY doc_id LIMIT 500")
def distinct_keep_first(spark, d):
    return C.keep_first(table(spark, d, "documents"), ["text"], ["doc_id"], 500).select("doc_id", "n_chars")


@query(
    """SELECT id, source, row_number() OVER (ORDER BY id NULLS FIRST, source) AS place FROM (SELECT CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderkey END AS id,
  'orders' AS source FROM orders UNION ALL SELECT l_orderkey, 'lineitem' FROM lineitem)"""
)
def merge_sorted(spark, d):
    return _merged(table(spark, d, "orders"), table(spark, d, "lineitem"))


def _merged(orders, lineitem):
    a = orders.select(F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderkey")).alias("id"), F.lit("orders").alias("source"))
    b = lineitem.select(F.col("l_orderkey").alias("id"), F.lit("lineitem").alias("source"))
    return running_number(a.unionByName(b), ["id", "source"], "place", 1)


@query(
    """SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY md5('split:' || doc_id), doc_id)
  <= floor(count(*) OVER (PARTITION BY lang) * 0.1) THEN 'val' ELSE 'train' END AS split FROM documents"""
)
def split_stratified(spark, d):
    return C.stratified_split(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 0.1, "split")


@query("SELECT doc_id, lang FROM documents ORDER BY md5('sample:' || doc_id), doc_id LIMIT 100")
def sample_n(spark, d):
    return C.sample_n(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 100, "sample")


@query("SELECT doc_id FROM documents QUALIFY row_number() OVER (ORDER BY doc_id) <= floor(count(*) OVER () * 0.25)")
def sample_fraction(spark, d):
    return C.head_fraction(table(spark, d, "documents").select("doc_id"), "doc_id", 0.25)


@query('SELECT vec_id, label FROM embeddings QUALIFY row_number() OVER (PARTITION BY "label" ORDER BY md5(\'class:\' || vec_id), vec_id) <= 20')
def k_per_class(spark, d):
    return C.k_per_class(table(spark, d, "embeddings").select("vec_id", "label"), "label", "vec_id", 20, "class")


@query("SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / ceil(count(*) OVER () / 7.0)) AS BIGINT) AS chunk FROM documents")
def chunks(spark, d):
    return C.chunks(table(spark, d, "documents").select("doc_id"), "doc_id", 7)


@query(
    """SELECT * FROM (SELECT o_orderkey AS id, 'orders' AS source FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey) <= floor(count(*) OVER () * 0.2))
UNION ALL SELECT * FROM (SELECT event_id, 'events' FROM events QUALIFY row_number() OVER (ORDER BY event_id) <= floor(count(*) OVER () * 0.5))"""
)
def weighted_union(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    events = table(spark, d, "events").select(F.col("event_id").alias("id"))
    return C.weighted_union([(orders, "id", 0.2, "orders"), (events, "id", 0.5, "events")])


@query(
    """SELECT item_id AS id, 'benchmark' AS source, 0 AS turn FROM (SELECT * FROM benchmark ORDER BY item_id LIMIT 20 OFFSET 10)
UNION ALL SELECT conv_id, 'conversation', turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) BETWEEN 2 AND 3"""
)
def range_slice(spark, d):
    a = C.slice_rows(table(spark, d, "benchmark"), ["item_id"], 10, 30).select(F.col("item_id").alias("id"), F.lit("benchmark").alias("source"), F.lit(0).cast("long").alias("turn"))
    b = C.slice_per_group(table(spark, d, "conversations"), ["conv_id"], ["turn"], 1, 3)
    return a.unionByName(b.select(F.col("conv_id").alias("id"), F.lit("conversation").alias("source"), "turn"))


@query("SELECT lang, count(l.doc_id) AS labelled, count(*) - count(l.doc_id) AS unlabelled FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def semi_anti(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").select("doc_id")
    have = docs.join(labels, "doc_id", "left_semi").withColumn("has", F.lit(1))
    lack = docs.join(labels, "doc_id", "left_anti").withColumn("has", F.lit(0))
    return have.unionByName(lack).groupBy("lang").agg(F.sum("has").alias("labelled"), F.sum(1 - F.col("has")).alias("unlabelled"))


@query(
    r"""WITH checked AS (SELECT d.doc_id, CASE WHEN contains(text, 'idiot') OR contains(text, 'scum') THEN '' ELSE substr(text, 1, 40) END AS prompt,
  CASE WHEN contains(text, '%%%') THEN '' ELSE 'clean' END AS output, l.quality FROM documents d JOIN labels l USING (doc_id)
  WHERE d.doc_id NOT IN (3, 5, 7) AND NOT EXISTS (SELECT 1 FROM events e WHERE e.event_id = d.doc_id AND e.event_type = 'click') AND d.lang = 'en')
SELECT *, CASE WHEN prompt = '' THEN 'skipped' WHEN output = '' THEN 'contaminated' WHEN quality = 0 THEN 'low' ELSE 'keep' END AS verdict FROM checked"""
)
def lookup_filters(spark, d):
    docs, labels = table(spark, d, "documents").where(~F.col("doc_id").isin(3, 5, 7) & (F.col("lang") == "en")), table(spark, d, "labels")
    done = table(spark, d, "events").where("event_type = 'click'").select(F.col("event_id").alias("doc_id"))
    text = F.col("text")
    open_docs = C.unfinished(docs, done, "doc_id").join(labels, "doc_id")
    prompt = F.when(C.no_stop_substring(text, ["idiot", "scum"]), F.substring("text", 1, 40)).otherwise("")
    output = F.when(F.contains(text, F.lit("%%%")), "").otherwise("clean")
    out = open_docs.select("doc_id", prompt.alias("prompt"), output.alias("output"), "quality")
    return out.withColumn("verdict", F.when(F.col("prompt") == "", "skipped").when(F.col("output") == "", "contaminated").when(F.col("quality") == 0, "low").otherwise("keep"))


@query(
    """SELECT 'intended' AS variant, id, origin FROM (SELECT c_custkey AS id, 'have' AS origin FROM customer
  UNION ALL SELECT * FROM (SELECT o_orderkey, 'more' FROM orders ORDER BY 1 LIMIT 20))
UNION ALL SELECT 'literal', id, origin FROM (SELECT c_custkey AS id, 'have' AS origin FROM customer
  UNION ALL SELECT * FROM (SELECT o_orderkey, 'more' FROM orders ORDER BY 1 LIMIT 21))"""
)
def top_up(spark, d):
    return _topped_up(table(spark, d, "customer"), table(spark, d, "orders"))


def _topped_up(customer, orders):
    have = customer.select(F.col("c_custkey").alias("id"), F.lit("have").alias("origin"))
    more = orders.select(F.col("o_orderkey").alias("id"), F.lit("more").alias("origin"))
    target = have.count() + 20
    both = [C.top_up(have, more, "id", target, lit).withColumn("variant", F.lit(v)) for v, lit in (("intended", False), ("literal", True))]
    return both[0].unionByName(both[1])


@query(
    """SELECT doc_id AS question_id, lang AS category, 0 AS prediction, CASE WHEN doc_id < 300 THEN doc_id WHEN doc_id < 600 THEN doc_id + 1000 ELSE doc_id + 5000 END AS new_id,
  CASE WHEN quality IS NULL THEN '{"id":' || doc_id || '}' ELSE '{"id":' || doc_id || ',"quality":' || quality || '}' END AS record
FROM documents LEFT JOIN labels USING (doc_id)"""
)
def submission(spark, d):
    joined = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    i = F.col("doc_id")
    new = F.when(i < 300, i).when(i < 600, i + 1000).otherwise(i + 5000)
    record = F.to_json(F.struct(i.alias("id"), F.col("quality").alias("quality")))  # a null field is left out
    return joined.select(i.alias("question_id"), F.col("lang").alias("category"), F.lit(0).alias("prediction"), new.alias("new_id"), record.alias("record"))


@query(
    """WITH few AS (SELECT 'few' AS kind, doc_id AS draw, doc_id AS pick FROM documents ORDER BY md5('few:' || doc_id), doc_id LIMIT 5),
epoch AS (SELECT 'epoch' AS kind, row_number() OVER (ORDER BY md5('e1:' || doc_id), doc_id) AS draw, doc_id AS pick FROM documents),
c AS (SELECT c_custkey AS k, c_custkey % 7 AS weight FROM customer WHERE c_custkey % 7 > 0),
w AS (SELECT k, sum(weight) OVER (ORDER BY k) AS hi, weight, sum(weight) OVER () AS total FROM c),
draws AS (SELECT i AS draw, ('0x' || substr(md5('w:' || i), 1, 8))::BIGINT / 4294967296.0 AS u FROM range((SELECT count(*) FROM customer)) t(i)),
drawn AS (SELECT 'weighted' AS kind, draw, k AS pick FROM draws JOIN w ON u * total >= hi - weight AND u * total < hi),
choice AS (SELECT 'choice' AS kind, event_id AS draw, CASE WHEN ('0x' || substr(md5('c:' || event_id), 1, 8))::BIGINT / 4294967296.0 < 0.2 THEN 0 ELSE 1 END AS pick FROM events)
SELECT * FROM few UNION ALL SELECT * FROM epoch UNION ALL SELECT * FROM drawn UNION ALL SELECT * FROM choice"""
)
def samplers(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    few = C.sample_n(docs, "doc_id", 5, "few").select(F.lit("few").alias("kind"), F.col("doc_id").alias("draw"), F.col("doc_id").alias("pick"))
    customers = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("k"), (F.col("c_custkey") % 7).alias("weight"))
    drawn = weighted_draws(customers, "k", "weight", customers.count(), "w").select(F.lit("weighted").alias("kind"), "draw", F.col("k").alias("pick"))
    return few.unionByName(_epoch(docs)).unionByName(drawn).unionByName(_choice(table(spark, d, "events")))


def _epoch(docs):
    return running_number(docs, [C.hash_order("e1", "doc_id"), "doc_id"], "draw", 1).select(F.lit("epoch").alias("kind"), "draw", F.col("doc_id").alias("pick"))


def _choice(events):
    unit = F.conv(F.substring(C.hash_order("c", "event_id"), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    return events.select(F.lit("choice").alias("kind"), F.col("event_id").alias("draw"), F.when(unit < 0.2, 0).otherwise(1).cast("long").alias("pick"))
