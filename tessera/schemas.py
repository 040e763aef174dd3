"""Declared schemas of the records, one a stage, each an extension of the one before; and the constants that go with them."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()
_SS = T.ArrayType(_S)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


BASE_PROMPT = _struct(("item_id", _S), ("t2i_category", _S), ("sub_category", _S), ("prompt", _S), ("concepts_and_relations", _S), ("relation", _S))
NEGATIVE_PROMPT = T.StructType([*BASE_PROMPT.fields, *_struct(("perturbed_method", _SS), ("negative_prompt", _SS)).fields])
DENSE_PROMPT = T.StructType([*NEGATIVE_PROMPT.fields, *_struct(("long_prompt", _SS), ("negative_long_prompt", _SS)).fields])
QUESTION = T.StructType([*BASE_PROMPT.fields, T.StructField("question", _SS)])
ANSWER = _struct(("p_yes", T.DoubleType()), ("p_no", T.DoubleType()), ("answer", _S))
CANDIDATE = _struct(("path", _S), ("local_score", T.DoubleType()), ("answer_metadata", T.ArrayType(ANSWER)))
VQA_RESULT = _struct(
    ("item_id", _S), ("t2i_category", _S), ("sub_category", _S), ("prompt", _S), ("question", _SS),
    ("base_metadata", T.MapType(_S, CANDIDATE)), ("negative_metadata", T.MapType(_S, CANDIDATE)),
)
TRAIN_PAIR = T.StructType(
    [*DENSE_PROMPT.fields, *_struct(("chosen", _S), ("rejected", _S), ("chosen_score", T.DoubleType()), ("rejected_score", T.DoubleType()), ("rejected_prompt", _S), ("nouns", _SS)).fields]
)

# Categories and their id prefixes.
CATEGORY_PREFIX = {"attribute": "0", "layout": "1", "non-spatial": "2", "complex": "3"}
# Number words that a layout prompt may and may not contain.
ALLOWED_NUMBERS = ["one", "two", "three", "four"]
DISALLOWED_NUMBERS = [
    "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen",
    "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety",
    "hundred", "thousand", "million", "billion",
]
# Perturbation methods by sub-category.
PERTURBATIONS = {
    "attribute1_color": ["replace", "replace", "replace"],
    "attribute1_texture": ["replace", "replace", "replace"],
    "attribute1_shape": ["replace", "replace", "replace"],
    "layout2": ["replace", "replace", "replace"],
    "non-spatial": ["replace", "drop", "replace"],
    "complex": ["replace", "swap", "drop"],
    "attribute2": ["replace", "swap", "drop"],
    "layout1": ["replace", "swap", "drop"],
    "layout3": ["replace", "swap", "drop"],
}
# Words that are no nouns to look for.
NOUN_STOPS = ["left", "right", "bottom", "top", "side", "row", "rows", "column", "columns", "front", "behind", "range"]
