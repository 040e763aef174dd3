"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.common import row_number, running_number
from tessera.plans.registry import query, table


def _turns(spark, d):
    """One row a conversation with its turns in order."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("turns"))


@query(
    """WITH a AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'B' WHEN 1 THEN 'C. ' || o_orderpriority WHEN 2 THEN 'I think. The answer is D.' WHEN 3 THEN 'The answer is A. The answer is B.'
  WHEN 4 THEN 'F' ELSE o_orderpriority END AS t FROM orders),
l AS (SELECT o_orderkey, CASE WHEN t IN ('A','B','C','D','E') THEN t WHEN length(t) >= 3 AND t[1] IN ('A','B','C','D','E') AND substr(t, 2, 2) = '. ' THEN t[1]
  WHEN len(regexp_extract_all(t, 'The answer is ([A-Z])\\.', 1)) = 1 THEN regexp_extract(t, 'The answer is ([A-Z])\\.', 1) ELSE 'FAILED' END AS letter FROM a)
SELECT o_orderkey, letter, coalesce(list_position(['A','B','C'], letter), 0) - 1 AS choice FROM l""".replace("\\\\", "\\")
)
def letter_parse(spark, d):
    k = F.col("o_orderkey") % 6
    t = F.when(k == 0, "B").when(k == 1, F.concat(F.lit("C. "), "o_orderpriority")).when(k == 2, "I think. The answer is D.").when(k == 3, "The answer is A. The answer is B.").when(k == 4, "F").otherwise(F.col("o_orderpriority"))
    options = ["A", "B", "C", "D", "E"]
    rows = table(spark, d, "orders").select("o_orderkey", X.choice_letter(t, options).alias("letter"))
    return rows.withColumn("choice", X.option_index(F.col("letter"), F.array(*map(F.lit, options)), F.lit(3)))


@query(
    """WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN value || ', ' || user_id || chr(10) || 'x' WHEN 1 THEN 'good 3' WHEN 2 THEN '1 2 3' ELSE user_id || ' ' || event_id END AS s,
  'a: ' || event_type || '; b: x:' || user_id || CASE WHEN event_id % 2 = 0 THEN '; c: z' ELSE '' END AS f FROM events),
p AS (SELECT *, list_filter(string_split(replace(string_split(s, chr(10))[1], ',', ' '), ' '), lambda x: x <> '') AS w FROM t),
n AS (SELECT *, len(w) = 2 AND try_cast(w[1] AS DOUBLE) IS NOT NULL AND try_cast(w[2] AS DOUBLE) IS NOT NULL AS good FROM p)
SELECT event_id, CASE WHEN good THEN try_cast(w[1] AS DOUBLE) ELSE -1.0 END AS first, CASE WHEN good THEN try_cast(w[2] AS DOUBLE) ELSE -1.0 END AS second,
  CASE WHEN event_id % 2 = 0 THEN (regexp_extract(f, 'x:([0-9]+)', 1)) END AS field,
  trim(string_split(f, 'b: ')[-1]) AS tail, regexp_extract(f, 'a: (.+)', 1) AS section FROM n"""
)
def score_pair_parse(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id") % 4
    s = F.when(k == 0, F.concat(F.col("value").cast("string"), F.lit(", "), "user_id", F.lit("\nx"))).when(k == 1, "good 3").when(k == 2, "1 2 3").otherwise(F.concat_ws(" ", "user_id", "event_id"))
    f = F.concat(F.lit("a: "), "event_type", F.lit("; b: x:"), "user_id", F.when(F.col("event_id") % 2 == 0, "; c: z").otherwise(""))
    rows = e.select("event_id", X.score_pair(s).alias("p"), f.alias("f"))
    fields = X.semicolon_fields(F.col("f"))
    return rows.select("event_id", F.get("p", 0).alias("first"), F.get("p", 1).alias("second"), F.get(fields, 1).alias("field"), X.after_marker(F.col("f"), "b: ").alias("tail"), X.section(F.col("f"), "a: ").alias("section"))


@query(
    """WITH p AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, '.'), lambda x: trim(x)), lambda x: x <> '' AND NOT contains(x, 'USER:') AND NOT contains(x, 'ASSISTANT:')) AS q FROM conversations)
SELECT conv_id, turn, len(list_distinct(q)) AS n, q[1] || '.' AS first FROM p"""
)
def question_split(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", X.split_questions(F.col("text"), ".").alias("q"))
    return rows.select("conv_id", "turn", F.size("q").cast("long").alias("n"), F.get("q", 0).alias("first"))


@query(
    """SELECT conv_id, string_agg(CASE WHEN coalesce(text, '') = '' THEN upper(role) || ':' ELSE upper(role) || ': ' || text || CASE WHEN i % 2 = 1 THEN ' ' ELSE '</s>' END END, '' ORDER BY turn) AS prompt
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) GROUP BY 1"""
)
def conv_render(spark, d):
    roles = {r: r.upper() for r in ("user", "assistant", "system", "human", "gpt")}
    return _turns(spark, d).select("conv_id", X.rendered(F.col("turns"), roles, [" ", "</s>"]).alias("prompt"))


@query(
    r"""SELECT conv_id, sum(len(regexp_extract_all(text, '\S+'))) * CASE WHEN conv_id % 2 = 0 THEN 1 ELSE -1 END + CASE WHEN conv_id % 2 = 0 THEN 128 ELSE 0 END AS length FROM conversations GROUP BY 1"""
)
def conv_lengths(spark, d):
    """Words of a conversation; every second one has an image, which counts 128, and the others carry a minus sign."""
    words = F.sum(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")))
    even = F.col("conv_id") % 2 == 0
    return table(spark, d, "conversations").groupBy("conv_id").agg(words.alias("n")).select("conv_id", F.when(even, F.col("n") + 128).otherwise(-F.col("n")).alias("length"))


@query(
    """SELECT conv_id, turn, role, row_number() OVER w - 1 AS place, coalesce(role <> lag(role) OVER w, true) AS alternates, first_value(role) OVER w AS opens,
  coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offset_chars
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""
)
def conv_roles(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return table(spark, d, "conversations").select(
        "conv_id", "turn", "role", (F.row_number().over(w) - 1).cast("long").alias("place"), F.coalesce(F.col("role") != F.lag("role").over(w), F.lit(True)).alias("alternates"), F.first("role").over(w).alias("opens"), before.alias("offset_chars")
    )


@query("SELECT event_type, count(*) AS n, round(avg(CAST(json_extract_string(props, '$.k') AS INT)), 6) AS mean_k FROM events GROUP BY 1")
def json_props(spark, d):
    k = F.from_json("props", "k int")["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg(k), 6).alias("mean_k"))


@query("SELECT sha1(html) AS name, min(page_id) AS page_id, count(*) AS copies, 'bin' AS kind FROM pages GROUP BY 1")
def blob_hash(spark, d):
    blob = F.col("html").cast("binary")
    return table(spark, d, "pages").groupBy(F.sha1(blob).alias("name")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("copies"), F.min(X.blob_type(blob)).alias("kind"))


@query()
def answer_normalise(spark, d):
    t = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", X.normalised_answer(t).alias("answer"), X.without_dots(t).alias("plain"), X.collapsed(t).alias("line"), X.yes_or_no(t).alias("verdict"))


def _tasks(spark) -> int:
    """Several tasks a core, so that long texts even out."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


@query()
def clean_text(spark, d):
    # texts are dealt out before they are cleaned: a file may be one task's, and cleaning is much more work than reading
    docs = table(spark, d, "documents").select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), F.col("text"))
    pages = table(spark, d, "pages").select(F.lit("pages").alias("source"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    rows = docs.unionByName(pages).repartition(_tasks(spark)).select("source", "id", X.cleaned_caption(F.col("text")).alias("caption"))
    return rows.withColumn("first_sentence", F.substring_index("caption", ".", 1))


@query(
    r"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(text, '\S+') AS w, length(text) % 5 AS k FROM conversations),
l AS (SELECT *, list_transform(w, lambda x: length(x)) AS ids, max(least(len(w), 40)) OVER (PARTITION BY conv_id) AS widest FROM t)
SELECT conv_id, turn, array_to_string(CASE WHEN len(ids) >= 8 THEN ids[1:8] ELSE list_concat(ids, list_transform(range(8 - len(ids)), lambda x: 0)) END, ' ') AS padded,
  widest - least(len(ids), 40) AS pads, coalesce(list_position(list_transform(range(1, greatest(len(ids), 1)), lambda i: ids[i] = 2 AND ids[i + 1] = 3), true), 0) - 1 AS found,
  len(ids) + 5 * len(list_filter(ids, lambda x: x = 3)) AS expanded, len(list_filter(range(len(ids)), lambda i: i >= 2 AND i < 5)) AS masked FROM l"""
)
def token_arrays(spark, d):
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.transform(words, lambda w: F.length(w)).alias("ids"))
    cut = F.slice("ids", 1, 40)
    widest = F.max(F.size(cut)).over(Window.partitionBy("conv_id"))
    filled = X.left_padded(cut, widest, -1)
    spans = F.array(F.struct(F.lit(2).alias("start"), F.lit(5).alias("end")))
    count = lambda a, v: F.size(F.filter(a, lambda x: x == v)).cast("long")
    return rows.select(
        "conv_id",
        "turn",
        F.array_join(F.transform(X.padded(F.col("ids"), 8), lambda x: x.cast("string")), " ").alias("padded"),
        count(filled, -1).alias("pads"),
        X.first_match(F.col("ids"), F.array(F.lit(2), F.lit(3))).cast("long").alias("found"),
        F.size(X.expanded(F.col("ids"), F.lit(3), 100, 4, 101)).cast("long").alias("expanded"),
        count(X.masked_labels(F.col("ids"), spans), -100).alias("masked"),
    )


@query(
    """SELECT p_partkey, '(A) ' || p_brand || ' (B) ' || p_type AS options, CASE WHEN p_size % 2 = 0 THEN 'Size ' || p_size || chr(10) ELSE '' END || p_name || chr(10) || 'A. ' || p_brand || chr(10) || 'B. ' || p_type AS lines,
  lower(p_name) AS question, CASE WHEN p_size % 3 = 0 THEN 'Hint: Please generate a python code to solve the problem' WHEN p_size % 3 = 1 THEN 'Hint: Please answer the question and provide the correct option letter, e.g., A, B, C, D, at the end.'
  ELSE 'Hint: Please answer the question requiring an integer answer and provide the final value, e.g., 1, 2, 3, at the end.' END AS hint FROM part"""
)
def prompt_render(spark, d):
    options = F.array("p_brand", "p_type")
    size = F.col("p_size") % 3
    hint = X.math_hint(F.when(size == 0, "code").otherwise("solution"), F.when(size == 1, "multi_choice").otherwise("free_form"), F.lit("integer"), F.lit(1))
    prompt = F.concat("p_name", F.lit("\nAnswer with one word."))
    return table(spark, d, "part").select(
        "p_partkey", X.option_list(options).alias("options"), X.lettered_lines(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Size "), "p_size")), F.col("p_name"), options).alias("lines"), X.prompt_question(prompt).alias("question"), hint.alias("hint")
    )


@query(
    """WITH c AS (SELECT c_custkey, CAST(c_custkey % 10 AS VARCHAR) || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS item_id, c_mktsegment FROM customer)
SELECT item_id, CASE WHEN item_id[1] IN ('0','1','2') THEN 'attribute' WHEN item_id[1] IN ('3','4','5') THEN 'layout' WHEN item_id[1] = '6' THEN 'non-spatial' WHEN item_id[1] = '7' THEN 'complex' WHEN item_id[1] = '8' THEN 'dpgbench' END AS eight,
  CASE item_id[1] WHEN '0' THEN 'attribute' WHEN '1' THEN 'layout' WHEN '2' THEN 'non-spatial' WHEN '3' THEN 'complex' END AS four,
  CASE c_custkey % 4 WHEN 0 THEN 'person' WHEN 1 THEN 'boat' WHEN 2 THEN 'tv' ELSE 'cat' END AS object, count(*) OVER (PARTITION BY c_mktsegment) AS inverted FROM c"""
)
def category_maps(spark, d):
    first = F.substring("item_id", 1, 1)
    eight = X.literal_map({"0": "attribute", "1": "attribute", "2": "attribute", "3": "layout", "4": "layout", "5": "layout", "6": "non-spatial", "7": "complex", "8": "dpgbench"})
    four = X.literal_map({"0": "attribute", "1": "layout", "2": "non-spatial", "3": "complex"})
    key = F.col("c_custkey")
    word = F.when(key % 4 == 0, "girl").when(key % 4 == 1, "ship").when(key % 4 == 2, "telivision").otherwise("cat")
    rows = table(spark, d, "customer").select(F.concat((key % 10).cast("string"), F.lpad(key.cast("string"), 6, "0")).alias("item_id"), "c_mktsegment", word.alias("word"))
    sizes = rows.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("inverted"))  # the inverted index has so many entries
    object_ = F.coalesce(X.literal_map(X.SYNONYMS)[F.col("word")], F.col("word"))
    return rows.select("item_id", eight[first].alias("eight"), four[first].alias("four"), object_.alias("object"), "c_mktsegment").join(sizes, F.col("c_mktsegment").eqNullSafe(F.col("segment"))).drop("c_mktsegment", "segment")


@query(
    """WITH m AS (SELECT doc_id, n_chars, (row_number() OVER (ORDER BY md5('mega:' || doc_id), doc_id) - 1) // 64 AS megabatch FROM documents)
SELECT doc_id, megabatch, row_number() OVER (PARTITION BY megabatch ORDER BY n_chars DESC, doc_id) AS place FROM m"""
)
def length_buckets(spark, d):
    """Documents in megabatches of 64 by a seeded order, longest first within each."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars", F.md5(F.concat(F.lit("mega:"), F.col("doc_id").cast("string")).cast("binary")).alias("h"))
    mega = running_number(docs, ["h", "doc_id"]).withColumn("megabatch", F.floor(F.col("ord") / 64).cast("long"))
    return mega.select("doc_id", "megabatch", row_number(["megabatch"], [F.desc("n_chars"), "doc_id"]).alias("place"))


