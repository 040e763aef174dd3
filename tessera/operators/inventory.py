"""Small operators of prompts, shards and token lists, as column expressions and narrow plans."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.common import hash_order, laid_out, running_number

#: Values that a side may have that is multiplied with every row.
SIDE_VALUES = 1000
# Number words.
NUMBER_WORDS = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}


def with_each(df: DataFrame, values: Sequence, name: str) -> DataFrame:
    """Every row with each of the values, which are few by declaration; a map over the rows, not a join."""
    if len(values) > SIDE_VALUES:
        raise ValueError(f"{len(values)} values; at most {SIDE_VALUES} are multiplied with every row")
    return df.withColumn(name, F.explode(F.array(*map(F.lit, values))))


def filled(template: Column, **fields: Column) -> Column:
    """The template with each {name} replaced by its field; null fields are empty."""
    for name, value in fields.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def by_category(category: Column, templates: dict[str, str], other: str) -> Column:
    """The template of a category from a small table."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in templates.items() for x in kv])[category], F.lit(other))


def phrase(seed: str, key: Column, phrases: Sequence[str]) -> Column:
    """One of the phrases by a repeatable hash of the key."""
    place = F.conv(F.substring(hash_order(seed, key), 1, 8), 16, 10).cast("long") % len(phrases)
    return F.element_at(F.array(*map(F.lit, phrases)), (place + 1).cast("int"))


def subset(df: DataFrame, key: str, ratio: float, seed: str) -> DataFrame:
    """round(ratio * n) rows (halves to even) by a repeatable random order; told by running numbers, so no partition gathers them."""
    n = round(ratio * df.count())
    return running_number(df, [hash_order(seed, key), key], "_ord").where(F.col("_ord") < n).drop("_ord")


def even_parts(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """part: the rows by order cut at the whole numbers below 0, n/k, 2n/k, ..., n."""
    n = max(df.count(), 1)
    rows = running_number(df, order, "_ord")
    guess = F.floor((F.col("_ord") + 1) * k / n - F.lit(1e-12))
    # separators are floor(i * n / k): the part is the last whose separator is not beyond the row
    part = F.greatest(F.lit(0), F.least(F.lit(k - 1), guess))
    at = lambda p: F.floor(p * n / k)
    part = F.when(at(part) > F.col("_ord"), part - 1).when((part < k - 1) & (at(part + 1) <= F.col("_ord")), part + 1).otherwise(part)
    return rows.withColumn("part", part.cast("long")).drop("_ord")


def remapped(value: Column, ranges: Sequence[tuple[int, int, int]]) -> Column:
    """Values in lo..hi-1 moved by an amount, range after range: a moved value may be moved again by a later one."""
    for lo, hi, by in ranges:
        value = F.when((value >= lo) & (value < hi), value + by).otherwise(value)
    return value


def with_sentinel(chunks: Column, sentinel: int, first: int) -> Column:
    """Token lists of the chunks with a sentinel between each two, and the first token once at the front."""
    body = F.flatten(F.transform(chunks, lambda c, i: F.when(i > 0, F.concat(F.array(F.lit(sentinel)), c)).otherwise(c)))
    return F.concat(F.array(F.lit(first)), body)


def kind_of(path: Column, kinds: Sequence[str], other: str) -> Column:
    """The kind that a component of the path names, the last such one; not one that merely holds its name."""
    parts = F.filter(F.split(path, "/"), lambda p: p.isin(*kinds))
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(other))


def trimmed(values: Column, mask: Column) -> Column:
    """The first values, as many as the mask has ones."""
    return F.slice(values, F.lit(1), F.aggregate(mask, F.lit(0), lambda s, x: s + x.cast("int")))


def most_important(words: Column, rank: Column, n: int) -> Column:
    """n words of the lowest rank (the earlier of equals), in their own order. rank: an array beside the words."""
    zipped = F.transform(F.arrays_zip(words.alias("w"), rank.alias("r")), lambda x, i: F.struct(x["r"].alias("r"), i.alias("i"), x["w"].alias("w")))
    kept = F.slice(F.array_sort(zipped), 1, n)
    back = F.array_sort(F.transform(kept, lambda x: F.struct(x["i"].alias("i"), x["w"].alias("w"))))
    return F.transform(back, lambda x: x["w"])


def span_and_holders(tokens: Column, target: Column, part: Column) -> Column:
    """Places (from 0) of the first run of tokens that equals the target, together with those of all tokens that hold the part."""
    n = F.size(target)
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1))), lambda s: F.slice(tokens, s, n) == target)
    run = F.when((F.size(starts) > 0) & (n > 0), F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: starts[0] - 1 + k)).otherwise(F.array().cast("array<int>"))
    held = F.filter(F.transform(tokens, lambda t, i: F.when(F.contains(t, part), i)), lambda i: i.isNotNull())
    return F.array_sort(F.array_union(run, held))


def numeracy(required: DataFrame, detected: DataFrame, key: str) -> DataFrame:
    """score by key: each required object gives half if it is present and half if its count is as asked; all weigh alike.
    required: key, object, n; detected: key, object, n."""
    have = detected.select(key, "object", F.col("n").alias("have"))
    points = F.when(F.col("have") > 0, 0.5).otherwise(0.0) + F.when(F.col("have") == F.col("n"), 0.5).otherwise(0.0)
    return required.join(have, [key, "object"], "left").groupBy(key).agg((F.sum(points) / F.count("*")).alias("score"))


def sample_groups(df: DataFrame, prefix: str, suffix: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """group: within a run of one prefix, a new group begins when a suffix comes that its group already has."""
    w = Window.partitionBy(*by).orderBy(*order)
    fresh = F.coalesce((F.col(prefix) != F.lag(prefix).over(w)).cast("int"), F.lit(1))
    runs = df.withColumn("_run", F.sum(fresh).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    steps = F.array_sort(F.collect_list(F.struct(*order, F.col(suffix).alias("_s"), F.col(prefix).alias("_p"))))
    start = F.struct(F.lit(0).alias("g"), F.array().cast("array<string>").alias("seen"), F.array().cast("array<int>").alias("out"))

    def fold(a: Column, s: Column) -> Column:
        again = F.array_contains(a["seen"], s["_s"].cast("string"))
        g = a["g"] + again.cast("int")
        seen = F.when(again, F.array(s["_s"].cast("string"))).otherwise(F.concat(a["seen"], F.array(s["_s"].cast("string"))))
        return F.struct(g.alias("g"), seen.alias("seen"), F.concat(a["out"], F.array(g)).alias("out"))

    # a run holds the files of neighbouring samples of one name: few rows
    folded = runs.groupBy(*by, "_run").agg(steps.alias("_rows")).withColumn("_g", F.aggregate("_rows", start, fold, lambda a: a["out"]))
    each = folded.select(*by, "_run", F.explode(F.arrays_zip("_rows", "_g")).alias("_x"))
    return each.select(*by, "_run", *[F.col(f"_x._rows.{c}").alias(c) for c in order], F.col("_x._rows._p").alias(prefix), F.col("_x._rows._s").alias(suffix), F.col("_x._g").cast("long").alias("group"))


def natural_key(text: Column) -> Column:
    """An array that sorts as people do: text in lower case and numbers by value, in turn, of any length; text comes first."""
    parts = F.regexp_extract_all(F.lower(text), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    digits = lambda x: F.regexp_replace(x, "^0+", "")
    keys = F.transform(parts, lambda x: F.when(F.rlike(x, F.lit("^[0-9]")), F.concat(F.lpad(F.length(digits(x)).cast("string"), 9, "0"), digits(x))).otherwise(x))
    return F.when(F.rlike(text, F.lit("^[0-9]")), F.concat(F.array(F.lit("")), keys)).otherwise(keys)


def containing(df: DataFrame, text: Column, words: DataFrame, name: str = "word") -> DataFrame:
    """Rows with each word that their text contains. A map over the rows, not a join: SIDE_VALUES words at a time, so that any number of
    words takes bounded plans, and a pass over the rows for each SIDE_VALUES of them."""
    listed = words.select(F.col(words.columns[0]).alias("w")).where("w is not null").distinct()
    few = sorted(r.w for r in listed.limit(SIDE_VALUES + 1).collect())
    if len(few) <= SIDE_VALUES:
        return _with_found(df, text, few, name)
    places = laid_out(running_number(listed, ["w"], "place"))
    out = None
    for at in range(0, places.count(), SIDE_VALUES):
        part = _with_found(df, text, [r.w for r in places.where((F.col("place") >= at) & (F.col("place") < at + SIDE_VALUES)).orderBy("w").collect()], name)
        out = part if out is None else out.unionByName(part)
    return out


def _with_found(df: DataFrame, text: Column, words: Sequence[str], name: str) -> DataFrame:
    held = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
    return df.withColumn(name, F.explode(F.filter(held, lambda w: F.contains(text, w))))


def even_chunks(rows: DataFrame, group: str, item: str, length: str, chunks: int) -> DataFrame:
    """group, item, length, chunk and slot: the items of a group, longest first, go to the chunk of the least total length that is not
    full; where the items do not divide evenly, they are dealt in turn. A group is a batch of bounded size."""

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([length, item], ascending=[False, True], kind="stable")
        n = len(pdf)
        if n % chunks:
            return pdf.assign(chunk=np.arange(n) % chunks, slot=np.arange(n) // chunks)
        open_chunks, chunk, slot = [(0, c, 0) for c in range(chunks)], [], []
        for x in pdf[length].tolist():
            load, c, held = heapq.heappop(open_chunks)
            chunk.append(c)
            slot.append(held)
            if held + 1 < n // chunks:
                heapq.heappush(open_chunks, (load + x, c, held + 1))
        return pdf.assign(chunk=chunk, slot=slot)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(group, item, length).schema) + ", chunk long, slot long"
    return rows.select(group, item, length).groupBy(group).applyInPandas(deal, schema)
