"""Queries of prompts, shards and token lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import curate as C
from tessera.operators import evaluate as E
from tessera.operators import inventory as I
from tessera.operators import prefer as P
from tessera.operators.common import running_number
from tessera.plans.registry import query, table

_TEMPLATES = ["a photo of {c}.", "a drawing of {c}.", "the {c}."]
_BY_LANG = {"de": "Frage zu {source}: {id}", "en": "Question about {source}: {id}"}
_PHRASES = ["on the left of", "on the right of", "above", "below", "next to", "near"]
_UNIT = "('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT"


@query(
    """SELECT p_brand AS class, t.i AS template, replace(t.x, '{c}', p_brand) AS prompt FROM (SELECT DISTINCT p_brand FROM part),
(VALUES (0, 'a photo of {c}.'), (1, 'a drawing of {c}.'), (2, 'the {c}.')) t(i, x)"""
)
def template_classes(spark, d):
    classes = table(spark, d, "part").select(F.col("p_brand").alias("class")).distinct()
    rows = I.with_each(classes, list(range(len(_TEMPLATES))), "template")
    text = F.element_at(F.array(*map(F.lit, _TEMPLATES)), F.col("template") + 1)
    return rows.select("class", "template", I.filled(text, c=F.col("class")).alias("prompt"))


@query("SELECT user_id, event_type, stop FROM (SELECT DISTINCT user_id, event_type FROM events), (VALUES (2), (13), (50)) s(stop)")
def stop_tokens(spark, d):
    return I.with_each(table(spark, d, "events").select("user_id", "event_type").distinct(), [2, 13, 50], "stop")


@query(
    f"""SELECT doc_id, replace(replace(CASE lang WHEN 'de' THEN 'Frage zu {{source}}: {{id}}' WHEN 'en' THEN 'Question about {{source}}: {{id}}' ELSE 'Tell of {{source}}' END,
  '{{source}}', coalesce(source, '')), '{{id}}', CAST(doc_id AS VARCHAR)) AS prompt,
  ['on the left of', 'on the right of', 'above', 'below', 'next to', 'near'][{_UNIT.format(seed="phrase", key="doc_id")} % 6 + 1] AS phrase FROM documents"""
)
def category_prompts(spark, d):
    docs = table(spark, d, "documents")
    text = I.filled(I.by_category(F.col("lang"), _BY_LANG, "Tell of {source}"), source=F.col("source"), id=F.col("doc_id"))
    return docs.select("doc_id", text.alias("prompt"), I.phrase("phrase", F.col("doc_id"), _PHRASES).alias("phrase"))


@query(
    """WITH r AS (SELECT o_orderkey AS id, 'R' AS object, [1, 2, 3, 4][o_orderkey % 4 + 1] AS n FROM orders UNION ALL SELECT o_orderkey, 'N', 2 FROM orders),
h AS (SELECT l_orderkey AS id, l_returnflag AS object, count(*) AS have FROM lineitem GROUP BY 1, 2)
SELECT id, round(avg(CASE WHEN have > 0 THEN 0.5 ELSE 0 END + CASE WHEN have = n THEN 0.5 ELSE 0 END), 6) AS score FROM r LEFT JOIN h USING (id, object) GROUP BY 1"""
)
def numeracy_required(spark, d):
    """Counts are asked for in words, and objects may be missing."""
    words = F.create_map(*[F.lit(x) for kv in I.NUMBER_WORDS.items() for x in kv])
    asked = F.element_at(F.array(*map(F.lit, ["one", "two", "three", "four"])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    each = F.explode(F.array(F.struct(F.lit("R").alias("object"), asked.alias("word")), F.struct(F.lit("N").alias("object"), F.lit("two").alias("word"))))
    required = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), each.alias("x")).select("id", "x.object", words[F.col("x.word")].alias("n"))
    detected = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("object")).agg(F.count("*").alias("n"))
    return I.numeracy(required, detected, "id").select("id", F.round("score", 6).alias("score"))


@query("SELECT doc_id FROM documents QUALIFY row_number() OVER (ORDER BY md5('subset:' || doc_id), doc_id) <= round_even(0.3 * count(*) OVER (), 0)")
def subset_ratio(spark, d):
    return I.subset(table(spark, d, "documents").select("doc_id"), "doc_id", 0.3, "subset")


@query(
    """WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents),
c AS (SELECT p, floor(p * n / 7)::BIGINT AS at FROM range(7) t(p), (SELECT count(*) AS n FROM documents))
SELECT doc_id, max(p) AS part FROM o JOIN c ON c.at <= o.i GROUP BY 1"""
)
def linspace_parts(spark, d):
    return I.even_parts(table(spark, d, "documents").select("doc_id"), ["doc_id"], 7)


@query(
    """WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents),
f AS (SELECT *, n + (64 - n % 64) % 64 AS total FROM o), e AS (SELECT doc_id, pos, total FROM f UNION ALL SELECT doc_id, pos + n, total FROM f WHERE pos < total - n),
r AS (SELECT doc_id, pos, total, ((pos + 1) * 4 - 1) // total AS rank FROM e)
SELECT doc_id, rank, pos - rank * total // 4 AS place, (pos - rank * total // 4) * 4 + rank + 32 AS global_index FROM r"""
)
def sharded_ranks(spark, d):
    rows = C.rank_shards(table(spark, d, "documents").select("doc_id"), ["doc_id"], 4, 64, fill_last=True)
    return rows.withColumn("global_index", C.interleaved_index(F.col("place"), F.col("rank"), 4, F.lit(32)))


@query(
    """WITH a AS (SELECT doc_id AS i, lang, source FROM documents), b AS (SELECT *, CASE WHEN i < 300 THEN i + 200 ELSE i END AS j FROM a),
c AS (SELECT *, CASE WHEN j >= 300 AND j < 600 THEN j + 1000 ELSE j END AS k FROM b), e AS (SELECT *, CASE WHEN k >= 1100 THEN k + 5 ELSE k END AS m FROM c)
SELECT i AS doc_id, m AS new_id, CASE WHEN i % 2 = 0 THEN lang ELSE source END AS caption, '{"question":"' || lang || '","answers":["' || source || '","' || lang || '"],"scores":{"first":' || i % 7 || '}}' AS record FROM e"""
)
def nested_records(spark, d):
    """Ids moved range after range, a caption by a key, and a nested record."""
    docs = table(spark, d, "documents")
    new = I.remapped(F.col("doc_id"), [(0, 300, 200), (300, 600, 1000), (1100, 2**62, 5)])
    caption = F.create_map(F.lit("even"), F.col("lang"), F.lit("odd"), F.col("source"))[F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd")]
    record = F.struct(F.col("lang").alias("question"), F.array("source", "lang").alias("answers"), F.struct((F.col("doc_id") % 7).alias("first")).alias("scores"))
    return docs.select("doc_id", new.alias("new_id"), caption.alias("caption"), F.to_json(record).alias("record"))


@query(
    """SELECT p_partkey, list_aggregate(list_concat([1], [length(x) FOR x IN string_split(p_name, ' ')], [-200], [length(x) FOR x IN string_split(p_type, ' ')], [-200], [length(x) FOR x IN string_split(p_brand, ' ')]), 'string_agg', ',') AS tokens,
  CASE WHEN p_size % 3 = 0 THEN 'base' WHEN p_size % 3 = 1 THEN 'negative' ELSE 'other' END AS kind FROM part"""
)
def sentinel_tokens(spark, d):
    """Word lengths stand for token ids; the root of the paths holds the name of a kind."""
    lengths = lambda c: F.transform(F.split(c, " "), lambda x: F.length(x))
    chunks = F.array(lengths("p_name"), lengths("p_type"), lengths("p_brand"))
    folder = F.when(F.col("p_size") % 3 == 0, "base").when(F.col("p_size") % 3 == 1, "negative").otherwise("x")
    path = F.concat(F.lit("/data/database/"), folder, F.lit("/"), F.col("p_partkey").cast("string"), F.lit("/00.png"))
    tokens = F.array_join(I.with_sentinel(chunks, -200, 1).cast("array<string>"), ",")
    return table(spark, d, "part").select("p_partkey", tokens.alias("tokens"), I.kind_of(path, ["base", "negative"], "other").alias("kind"))


@query(
    """SELECT vec_id, len(embedding[1:vec_id % 64 + 1]) AS kept, round(list_sum(embedding[1:vec_id % 64 + 1]::DOUBLE[]), 6) AS total FROM embeddings"""
)
def trimmed_vectors(spark, d):
    mask = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i <= F.col("vec_id") % 64).cast("int"))
    v = I.trimmed(F.col("embedding"), mask)
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.size(v).cast("long").alias("kept"), F.round(total, 6).alias("total"))


@query(
    """WITH w AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), u AS (SELECT item_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM w),
k AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN length(x) > 6 THEN 0 WHEN length(x) > 3 THEN 1 ELSE 2 END, i) <= 12),
t AS (SELECT item_id, string_agg(x, ' ' ORDER BY i) AS kept FROM k GROUP BY 1),
h AS (SELECT item_id, i FROM u WHERE contains(x, 'an') UNION SELECT item_id, unnest([1, 2]) FROM w WHERE len(w) >= 3)
SELECT item_id, kept, (SELECT string_agg(i, ',' ORDER BY i) FROM h WHERE h.item_id = t.item_id) AS places FROM t"""
)
def word_priority(spark, d):
    """The dozen most important words in their order; places of the second and third word and of all that hold "an"."""
    words = F.split("text", " ")
    rank = F.transform(words, lambda x: F.when(F.length(x) > 6, 0).when(F.length(x) > 3, 1).otherwise(2))
    rows = table(spark, d, "benchmark").select("item_id", words.alias("w"), rank.alias("r"))
    kept = F.array_join(I.most_important(F.col("w"), F.col("r"), 12), " ")
    # the run is sought from its own first place: the words before it are blanked
    seen = F.transform("w", lambda x, i: F.when(i < 1, F.concat(F.lit("\u0001"), x)).otherwise(x))
    places = I.span_and_holders(seen, F.slice("w", 2, 2), F.lit("an"))
    places = F.when(F.size("w") >= 3, places).otherwise(I.span_and_holders(F.col("w"), F.array().cast("array<string>"), F.lit("an")))
    text = F.array_join(places.cast("array<string>"), ",")
    return rows.select("item_id", kept.alias("kept"), F.when(text != "", text).alias("places"))


@query(
    """SELECT p_partkey, CASE WHEN least(p_size, p_size * 2 - 10) >= 15 THEN 1 ELSE 0 END AS valid FROM part"""
)
def valid_sizes(spark, d):
    return table(spark, d, "part").select("p_partkey", C.large_enough(F.col("p_size"), F.col("p_size") * 2 - 10, 15).alias("valid"))


@query(
    """SELECT event_id, user_id, round(quantile_cont(value, 0.5) OVER m, 6) AS median, round(min(value) OVER l, 6) AS least, round(max(value) OVER l, 6) AS most FROM events
WINDOW m AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 127 PRECEDING AND CURRENT ROW), l AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"""
)
def profile_meter(spark, d):
    """Median of the last 128, least and most of the last 10."""
    by = Window.partitionBy("user_id").orderBy("event_id")
    long, short = by.rowsBetween(-127, 0), by.rowsBetween(-9, 0)
    one = lambda f, w: F.round(f.over(w), 6)
    return table(spark, d, "events").select("event_id", "user_id", one(F.percentile("value", F.lit(0.5)), long).alias("median"), one(F.min("value"), short).alias("least"), one(F.max("value"), short).alias("most"))


@query(
    """WITH RECURSIVE o AS MATERIALIZED (SELECT l_suppkey, l_orderkey, l_linenumber, l_returnflag || l_linestatus AS file, l_returnflag AS name, l_linestatus AS suffix, row_number() OVER w AS r, coalesce(l_returnflag <> lag(l_returnflag) OVER w, true) AS fresh
  FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_returnflag || l_linestatus)),
g AS (SELECT l_suppkey, l_orderkey, l_linenumber, file, name, suffix, r, 1::BIGINT AS _run, 0::BIGINT AS grp, [suffix] AS seen FROM o WHERE r = 1
UNION ALL SELECT o.l_suppkey, o.l_orderkey, o.l_linenumber, o.file, o.name, o.suffix, o.r, _run + o.fresh::BIGINT, CASE WHEN o.fresh THEN 0 ELSE grp + list_contains(seen, o.suffix)::BIGINT END,
  CASE WHEN o.fresh OR list_contains(seen, o.suffix) THEN [o.suffix] ELSE list_append(seen, o.suffix) END FROM g JOIN o ON o.l_suppkey = g.l_suppkey AND o.r = g.r + 1)
SELECT l_suppkey, _run, l_orderkey, l_linenumber, file, name, suffix, grp AS "group" FROM g"""
)
def sample_groups(spark, d):
    """Files of a shard: names by order, kinds by line; a name's run breaks when a kind comes again."""
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("name"), F.col("l_linestatus").alias("suffix"), F.concat("l_returnflag", "l_linestatus").alias("file"))
    return I.sample_groups(rows, "name", "suffix", ["l_suppkey"], ["l_orderkey", "l_linenumber", "file"])


@query(
    """WITH RECURSIVE b AS MATERIALIZED (SELECT l_orderkey, l_partkey % 7 AS x, l_suppkey % 5 AS y, l_returnflag AS label, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey % 7, l_suppkey % 5, l_returnflag) AS r FROM lineitem),
k AS (SELECT l_orderkey, r, [struct_pack(x, y, label)] AS kept FROM b WHERE r = 1
UNION ALL SELECT b.l_orderkey, b.r, CASE WHEN len(list_filter(kept, lambda e: e.label = b.label AND greatest(6 - abs(e.x - b.x), 0) * greatest(6 - abs(e.y - b.y), 0)
  >= 0.5 * (72 - greatest(6 - abs(e.x - b.x), 0) * greatest(6 - abs(e.y - b.y), 0)))) > 0 THEN kept ELSE list_append(kept, struct_pack(x := b.x, y := b.y, label := b.label)) END
  FROM k JOIN b ON b.l_orderkey = k.l_orderkey AND b.r = k.r + 1)
SELECT l_orderkey, CAST(r AS INTEGER) AS boxes, CAST(len(kept) AS INTEGER) AS kept FROM k QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY r DESC) = 1"""
)
def box_dedup(spark, d):
    """Lines of an order as boxes of its part numbers and amounts, without those that a kept one of their flag covers."""
    side = lambda c, n: (F.col(c) % n).cast("double")
    box = F.struct(side("l_partkey", 7).alias("x0"), side("l_suppkey", 5).alias("y0"), (side("l_partkey", 7) + 6).alias("x1"), (side("l_suppkey", 5) + 6).alias("y1"), F.col("l_returnflag").alias("label"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", box.alias("b")))).alias("x"))
    boxes = F.transform("x", lambda s: s["b"])
    return rows.select("l_orderkey", F.size(boxes).alias("boxes"), F.size(E.distinct_boxes(boxes, 0.5)).alias("kept"))


@query(
    """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'no_score' WHEN p_size % 3 = 0 THEN 'tie' WHEN p_size > 25 THEN 'yes' ELSE 'no' END AS decision FROM part"""
)
def decisions(spark, d):
    """Answers by probabilities; a score that is not a number is no score."""
    p = F.when(F.col("p_size") % 3 == 0, F.lit(25)).otherwise(F.col("p_size"))
    score = F.when(F.col("p_size") % 5 == 0, F.lit(float("nan"))).otherwise(1.0)
    made = P.scored_decision(p, F.when(F.col("p_size") == 25, F.lit(26)).otherwise(F.lit(25)), score)
    return table(spark, d, "part").select("p_partkey", made.alias("decision"))


@query(
    """WITH t AS (SELECT p_partkey, lower(p_brand || '/' || p_size || '-' || p_name || '.' || p_partkey) AS t FROM part),
k AS (SELECT p_partkey, [CASE WHEN e[1] BETWEEN '0' AND '9' THEN lpad(CAST(length(ltrim(e, '0')) AS VARCHAR), 9, '0') || ltrim(e, '0') ELSE e END FOR e IN regexp_extract_all(t, '[0-9]+|[^0-9]+')] AS k FROM t)
SELECT p_partkey, row_number() OVER (ORDER BY k, p_partkey) AS place FROM k"""
)
def natural_order(spark, d):
    """Names with several numbers in them."""
    name = F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string"), F.lit("-"), "p_name", F.lit("."), F.col("p_partkey").cast("string"))
    return running_number(table(spark, d, "part").select("p_partkey", I.natural_key(name).alias("k")), ["k", "p_partkey"], "place", 1).drop("k")


@query(
    """SELECT label, word FROM (SELECT DISTINCT lower(p_name || ' ' || p_type) AS label FROM part) l
JOIN (SELECT lower(string_split(p_type, ' ')[-1]) AS word FROM part UNION SELECT lower(string_split(p_name, ' ')[1]) FROM part) w ON contains(label, word)"""
)
def label_words(spark, d):
    """Labels with each word of a small table that they contain."""
    parts = table(spark, d, "part")
    word = lambda c, k: parts.select(F.lower(F.element_at(F.split(c, " "), k)).alias("word"))
    labels = parts.select(F.lower(F.concat("p_name", F.lit(" "), "p_type")).alias("label")).distinct()
    return I.containing(labels, F.col("label"), word("p_type", -1).union(word("p_name", 1)))


@query(
    """WITH t AS (SELECT p_partkey, p_size, p_name, CASE WHEN p_size % 2 = 0 THEN 'Question: ' || p_name || ' Question: ' || p_type ELSE p_name || ' Question: ' || p_type END AS q,
  CASE WHEN p_size % 3 = 0 THEN p_size || ', 12 x' ELSE p_name END || chr(10) || p_brand || chr(10) || p_type AS l FROM part)
SELECT p_partkey, CASE WHEN starts_with(q, 'Question: ') THEN replace(q, 'Question: ', '') ELSE q END AS bare, array_to_string(string_split(l, chr(10))[2:], chr(10)) AS tail,
  array_to_string(string_split(l, chr(10))[:-2], chr(10)) AS head, CASE WHEN p_size % 3 = 0 THEN array_to_string(string_split(l, chr(10))[2:], chr(10)) ELSE l END AS unnumbered,
  CAST(p_partkey AS VARCHAR) AS stem, CAST(p_size AS VARCHAR) AS folder,
  CASE WHEN greatest(p_size, 20) > greatest(30, p_size % 40) THEN 'yes' WHEN greatest(p_size, 20) < greatest(30, p_size % 40) THEN 'no' ELSE 'tie' END AS answer FROM t"""
)
def text_trims(spark, d):
    """Prefixes, hanging lines, lines of numbers, pieces of paths, and answers by the likelier of two spellings."""
    size, end = F.col("p_size"), F.lit("\n")
    asked = F.concat(F.when(size % 2 == 0, "Question: ").otherwise(""), "p_name", F.lit(" Question: "), "p_type")
    first = F.when(size % 3 == 0, F.concat(size.cast("string"), F.lit(", 12 x"))).otherwise(F.col("p_name"))
    text = F.concat(first, end, "p_brand", end, "p_type")
    path = F.concat(F.lit("/data/"), size.cast("string"), F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".png"))
    answer = P.decision(F.greatest(size, F.lit(20)), F.greatest(F.lit(30), size % 40))
    return table(spark, d, "part").select(
        "p_partkey", X.without_prefix(asked, "Question: ").alias("bare"), X.without_lines(text, 1).alias("tail"), X.without_lines(text, 1, first=False).alias("head"),
        X.without_number_line(text).alias("unnumbered"), X.stem(path).alias("stem"), X.path_part(path, 2).alias("folder"), answer.alias("answer"),
    )


@query()
def length_chunks(spark, d):
    """Documents in megabatches of 64 by a seeded order, each split evenly by length over 8 workers."""
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.md5(F.concat(F.lit("mega:"), F.col("doc_id").cast("string")).cast("binary")).alias("h"))
    mega = running_number(docs, ["h", "doc_id"]).withColumn("megabatch", F.floor(F.col("ord") / 64).cast("long"))
    return I.even_chunks(mega, "megabatch", "doc_id", "n_chars", 8)
