"""SQL twins (DuckDB) of the queries that SQL can express on whole tables."""

from __future__ import annotations

from tessera.llm.quality_rules import GRID

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LOWER_LINE = _LOWER.replace("coalesce(text, '')", "line")
_CUTS = " UNION ALL ".join(f"SELECT '{r}' AS rule, {c} AS cutoff" for r, cuts in GRID.items() for c in cuts)
_MANY = sum(map(len, GRID.values()))

LINE_DEDUP = rf"""
WITH d AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r FROM documents),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM d),
s AS (SELECT r, line, row_number() OVER (ORDER BY r, k) AS place, list_sort(list_distinct(regexp_extract_all({_LOWER_LINE}, '[^\x20\x09-\x0D]+'))) AS w FROM l),
u AS (SELECT w, len(w) AS n, min(place) AS place FROM s WHERE len(w) > 0 GROUP BY w),
t AS (SELECT *, unnest(w) AS x FROM u),
p AS (SELECT place, n, w, x FROM t JOIN (SELECT x, count(*) AS f FROM t GROUP BY x) USING (x) QUALIFY row_number() OVER (PARTITION BY place ORDER BY f, x) <= n - (4 * n + 4) // 5 + 1),
m AS (SELECT DISTINCT b.place FROM p a JOIN p b ON a.x = b.x AND a.place < b.place AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n WHERE 180 * len(list_intersect(a.w, b.w)) >= 80 * (a.n + b.n)),
k AS (SELECT r, string_agg(line, chr(10) ORDER BY place) AS text FROM s WHERE len(w) = 0 OR place IN (SELECT place FROM u WHERE place NOT IN (FROM m)) GROUP BY r)
SELECT doc_id, length(coalesce(k.text, '')) AS n_chars, sha256(coalesce(k.text, '')) AS text_sha256 FROM d LEFT JOIN k USING (r)"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS x FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 75 * (na.n + nb.n - shared)),
r AS (SELECT a AS doc_id, a AS other FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a),
m AS (SELECT doc_id, min(other) AS least FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) AS component_id, d.doc_id <= coalesce(m.least, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, w[i : i + 4] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
hot AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM hot, range(5) t(k) GROUP BY 1),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
b AS (SELECT doc_id, lang, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
      length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM d JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
v AS (SELECT doc_id, lang, base_failed, unnest([{{'rule': 'symbol_share', 'value': coalesce(n_symbols / nullif(word_chars, 0), 0)}}, {{'rule': 'dup_line_share', 'value': coalesce(n_dup_lines / nullif(n_lines, 0), 0)}},
      {{'rule': 'repeat_share', 'value': coalesce(n_repeat_words / nullif(n_words, 0), 0)}}, {{'rule': 'mean_word_chars', 'value': coalesce(word_chars / nullif(n_words, 0), 0)}}], recursive := true) FROM f),
g AS ({_CUTS}),
h AS (SELECT lang, v.rule, cutoff, count(*) AS n, count(*) FILTER (value > cutoff) AS k FROM v JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) USING (doc_id) JOIN g ON g.rule = v.rule WHERE NOT base_failed GROUP BY ALL),
q AS (SELECT *, (SELECT count(DISTINCT lang) FROM h) AS strata, {0.02 / len(GRID)} AS p FROM h),
t AS (SELECT lang, rule, cutoff FROM q WHERE list_sum(list_transform(range(k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(p) + (n - j) * ln(1 - p)))) <= 0.05 / ({_MANY} * strata)),
c AS (SELECT lang, rule, min(cutoff) AS cutoff FROM t GROUP BY 1, 2),
bad AS (SELECT DISTINCT doc_id FROM v JOIN c ON c.lang IS NOT DISTINCT FROM v.lang AND c.rule = v.rule AND value > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM f"""

HARD_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE label <> own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10"""

SQL = {"op4_line_dedup": LINE_DEDUP, "op9_quality_rules": QUALITY_RULES, "op10_near_duplicates": NEAR_DUPLICATES, "op12_hard_negatives": HARD_NEGATIVES}
