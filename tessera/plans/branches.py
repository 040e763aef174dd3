"""Queries whose rows reach every branch of the text rules: kinds of blobs, number words, prompt layouts, hints and methods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import text as X
from tessera.operators import curate as C
from tessera.plans.registry import query, table

#: First bytes in hex: one of each image format, two containers that differ at the end, and one that is cut short.
_HEADS = ["FFD8FFE0", "89504E470D0A1A0A", "474946383761", "474946383961", "00000100", "524946460000000057454250", "524946460000000057415645", "89504E47", "3C68746D6C3E"]
#: As many digits of the key behind each.
_TAILS = [16, 16, 16, 16, 16, 16, 16, 6, 16]
_WORDS = [*schemas.ALLOWED_NUMBERS, *schemas.DISALLOWED_NUMBERS, "phone", "someone", "ten-fold", "Two", "NINE", "one"]
_SHOTS = ["code", "solution"]
_FORMS = [("multi_choice", "text", 1), ("free_form", "integer", 1), ("free_form", "float", 1), ("free_form", "float", 2), ("free_form", "float", 3), ("free_form", "list", 1), ("free_form", "text", 1)]


def _pick(values: list, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(at, F.lit(len(values))) + 1).cast("int"))


@query(
    f"""WITH b AS (SELECT p_partkey, unhex({_HEADS}[p_partkey % 9 + 1] || lpad(CAST(p_partkey AS VARCHAR), {_TAILS}[p_partkey % 9 + 1], '0')) AS blob FROM part)
SELECT p_partkey, ['jpg', 'png', 'gif', 'gif', 'ico', 'webp', 'bin', 'bin', 'bin'][p_partkey % 9 + 1] AS kind, sha1(blob) AS name FROM b"""
)
def blob_kinds(spark, d):
    key = F.col("p_partkey")
    tail = F.lpad(key.cast("string"), _pick(_TAILS, key), F.lit("0"))
    blob = F.unhex(F.concat(_pick(_HEADS, key), tail))
    return table(spark, d, "part").select("p_partkey", blob.alias("blob")).select("p_partkey", X.blob_type(F.col("blob")).alias("kind"), F.sha1("blob").alias("name"))


@query(
    f"""WITH t AS (SELECT p_partkey, regexp_extract_all(lower({_WORDS}[p_partkey % {len(_WORDS)} + 1] || ' ' || p_name || ' and ' || {_WORDS}[p_partkey // 7 % {len(_WORDS)} + 1]), '[a-z]+') AS w FROM part)
SELECT p_partkey, CASE WHEN list_has_any(w, {schemas.DISALLOWED_NUMBERS}) THEN 'disallowed' WHEN NOT list_has_any(w, {schemas.ALLOWED_NUMBERS}) THEN 'missing' ELSE 'keep' END AS verdict,
  NOT list_has_any(w, {schemas.DISALLOWED_NUMBERS}) AS weak FROM t"""
)
def number_words(spark, d):
    key = F.col("p_partkey")
    text = F.concat_ws(" ", _pick(_WORDS, key), "p_name", F.lit("and"), _pick(_WORDS, F.floor(key / 7)))
    rows = table(spark, d, "part").select("p_partkey", text.alias("text"))
    allowed, disallowed = schemas.ALLOWED_NUMBERS, schemas.DISALLOWED_NUMBERS
    return rows.select("p_partkey", C.word_verdict(F.col("text"), allowed, disallowed).alias("verdict"), C.no_disallowed(F.col("text"), disallowed).alias("weak"))


@query(
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 5 THEN NULL WHEN 0 THEN lower(p_name) || chr(10) || 'of ' || lower(p_type) || '?' ELSE lower(p_name) || '?' END AS question FROM part"""
)
def prompt_layouts(spark, d):
    """A question among tokens (over two lines, too), one before its tokens, one after them, one alone, and a prompt of no layout."""
    key, name = F.pmod("p_partkey", F.lit(6)), F.col("p_name")
    prompt = (
        F.when(key == 0, F.concat(F.lit("OCR tokens: a, b. Question: "), name, F.lit("\nof "), F.col("p_type"), F.lit("? Short answer:")))
        .when(key == 1, F.concat(F.lit("OCR tokens: . Question: "), name, F.lit("? Short answer:")))
        .when(key == 2, F.concat(name, F.lit("?\nReference OCR token: a, b\nAnswer with one word.")))
        .when(key == 3, F.concat(name, F.lit("?\nAnswer with one word.")))
        .when(key == 4, F.concat(F.lit("Reference OCR token: a, b\n"), name, F.lit("?\nAnswer with one word.")))
        .otherwise(F.concat(name, F.lit("?")))
    )
    return table(spark, d, "part").select("p_partkey", X.prompt_question(prompt).alias("question"))


def _hint_case() -> str:
    of = {"multi_choice text 1": "choice", "free_form integer 1": "integer", "free_form float 1": "one place", "free_form float 2": "two places", "free_form list 1": "list"}
    whens = " ".join(f"WHEN {k} THEN '{X.HINTS[of[name]]}'" for k, name in enumerate(" ".join(map(str, f)) for f in _FORMS) if name in of)
    return f"CASE WHEN p_partkey // 7 % 2 = 0 THEN '{X.HINTS['code']}' ELSE CASE p_partkey % 7 {whens} END END"


@query(f"SELECT p_partkey, {_hint_case()} AS hint FROM part")
def hint_forms(spark, d):
    key = F.col("p_partkey")
    kind, answer, places = (_pick([f[k] for f in _FORMS], key) for k in range(3))
    return table(spark, d, "part").select("p_partkey", X.math_hint(_pick(_SHOTS, F.floor(key / 7)), kind, answer, places).alias("hint"))


@query(
    "SELECT p_partkey, s.name AS sub_category, s.methods FROM part JOIN (VALUES "
    + ", ".join(f"({k}, '{n}', '{','.join(m)}')" for k, (n, m) in enumerate(schemas.PERTURBATIONS.items()))
    + f") s(k, name, methods) ON p_partkey % {len(schemas.PERTURBATIONS)} = s.k"
)
def sub_category_methods(spark, d):
    """The methods of each of the declared sub-categories; one that is not declared would raise."""
    sub = _pick(list(schemas.PERTURBATIONS), F.col("p_partkey"))
    rows = table(spark, d, "part").select("p_partkey", sub.alias("sub_category"))
    rules = [(F.col("sub_category") == n, F.array(*map(F.lit, m))) for n, m in schemas.PERTURBATIONS.items()]
    return rows.select("p_partkey", "sub_category", F.array_join(C.rule_column(F.col("sub_category"), rules), ",").alias("methods"))
