"""Prompt tables: ids, validity, assembly, repair, splits and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.common import hash_order, row_number, running_number, top_k

#: Rows that a limit may gather in one partition.
LIMIT_ROWS = 10_000


def running_ids(df: DataFrame, prefix: Column, by: Sequence[str], order: Sequence[str], cap: int | None = None, literal_cap: bool = False) -> DataFrame:
    """item_id: the prefix and a six-digit number that runs from 0 in each group. literal_cap keeps one row beyond the cap."""
    n = row_number(by, order)
    out = df.withColumn("_n", n)
    if cap is not None:
        out = out.where(F.col("_n") <= cap + int(literal_cap))
    return out.withColumn("item_id", F.concat(prefix, F.lpad((F.col("_n") - 1).cast("string"), 6, "0"))).drop("_n")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-zA-Z]+"), 0)


def word_verdict(text: Column, allowed: Sequence[str], disallowed: Sequence[str]) -> Column:
    """keep, missing (no listed word at all) or disallowed."""
    w = words(text)
    bad = F.exists(w, lambda x: x.isin(*disallowed))
    some = F.exists(w, lambda x: x.isin(*allowed))
    return F.when(bad, "disallowed").when(~some, "missing").otherwise("keep")


def no_disallowed(text: Column, disallowed: Sequence[str]) -> Column:
    return ~F.exists(words(text), lambda x: x.isin(*disallowed))


def no_stop_substring(text: Column, stops: Sequence[str]) -> Column:
    found = F.lit(False)
    for s in stops:
        found = found | F.contains(text, F.lit(s))
    return ~found


def rule_column(value: Column, rules: Sequence[tuple[Column, Column]], existing: Column | None = None) -> Column:
    """The first rule that holds, unless the row has a value; unknown rows raise."""
    out = None
    for condition, result in rules:
        out = F.when(condition, result) if out is None else out.when(condition, result)
    out = out.otherwise(F.raise_error(F.concat(F.lit("unknown value: "), value.cast("string"))))
    return out if existing is None else F.coalesce(existing, out)


def union_first(frames: Sequence[DataFrame], key: str, order: Sequence[str] = ()) -> DataFrame:
    """All rows of the frames, of each key the first by frame, then order."""
    out = None
    for k, f in enumerate(frames):
        f = f.withColumn("_rank_of", F.lit(k))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return top_k(out, [key], ["_rank_of", *order]).drop("_rank_of")


def sorted_by_number(df: DataFrame, key: str) -> DataFrame:
    """By the key as a number; if any key is none, in the order of the text."""
    number = F.col(key).try_cast("long")
    whole = df.agg(F.bool_and(number.isNotNull()).alias("_all"))
    return df.join(F.broadcast(whole)).orderBy(F.when(F.col("_all"), number), key).drop("_all")


def keep_first(df: DataFrame, key: Sequence[str | Column], order: Sequence[str], limit: int | None = None) -> DataFrame:
    """Distinct by key, of each the first; at most `limit` rows in that order."""
    out = top_k(df, key, order)
    return out if limit is None else out.orderBy(*order).limit(limit)


def stratified_split(df: DataFrame, by: str, key: str, ratio: float, seed: str) -> DataFrame:
    """split: floor(n * ratio) rows of each stratum are val, by a repeatable random order; the rest is train."""
    # strata may be few and large: ranks follow from running numbers over the whole table, not from a window a stratum
    ranked = running_number(df, [by, hash_order(seed, key), key], "_ord")
    strata = ranked.groupBy(F.col(by).alias("_by")).agg(F.min("_ord").alias("_first"), F.count("*").alias("_n"))
    of = ranked.join(strata, F.col(by).eqNullSafe(F.col("_by")))
    return of.withColumn("split", F.when(F.col("_ord") - F.col("_first") < F.floor(F.col("_n") * ratio), "val").otherwise("train")).drop("_ord", "_by", "_first", "_n")


def sample_n(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows without replacement: the first by hash, taken by a distributed top-n."""
    return df.orderBy(hash_order(seed, key), key).limit(n)


def head_fraction(df: DataFrame, key: str, fraction: float) -> DataFrame:
    """The first floor(n * fraction) rows by key."""
    return first_rows(df, key, int(df.count() * fraction))


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows by key. A limit gathers its rows in one partition, so many are told by their running numbers."""
    return df.orderBy(key).limit(n) if n <= LIMIT_ROWS else running_number(df, [key], "_ord").where(F.col("_ord") < n).drop("_ord")


def k_per_class(df: DataFrame, by: str, key: str, k: int, seed: str) -> DataFrame:
    return top_k(df, [by], [hash_order(seed, key), key], k)


def chunks(df: DataFrame, key: str, k: int) -> DataFrame:
    """chunk: contiguous chunks of ceil(n / k) rows by key; there may be fewer than k."""
    size = -(-df.count() // k)
    return running_number(df, [key]).withColumn("chunk", F.floor(F.col("ord") / max(size, 1)).cast("long")).drop("ord")


def slice_rows(df: DataFrame, order: Sequence[str], start: int | None = None, stop: int | None = None) -> DataFrame:
    """Rows start..stop-1 by order; negative bounds count from the end."""
    if (start or 0) < 0 or (stop or 0) < 0:
        n = df.count()
        start, stop = (max(0, n + x) if x is not None and x < 0 else x for x in (start, stop))
    out = df.orderBy(*order)
    if start:
        out = out.offset(start)
    return out if stop is None else out.limit(max(0, stop - (start or 0)))


def slice_per_group(df: DataFrame, by: Sequence[str], order: Sequence[str], start: int, stop: int) -> DataFrame:
    n = row_number(by, order)
    return df.withColumn("_n", n).where((F.col("_n") > start) & (F.col("_n") <= stop)).drop("_n")


def weighted_union(parts: Sequence[tuple[DataFrame, str, float, str]]) -> DataFrame:
    """The first floor(n * share) rows by key of each part, with the part's name. parts: frame, key, share, name."""
    out = None
    for f, key, share, name in parts:
        f = head_fraction(f, key, share).withColumn("source", F.lit(name))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def top_up(have: DataFrame, more: DataFrame, key: str, target: int, literal: bool = False) -> DataFrame:
    """have, filled up to the target with the first rows of more by key. literal adds one row at least, as an append
    that is only checked afterwards does."""
    missing = target - have.count()
    n = max(1, missing + 1) if literal else max(0, missing)
    return have.unionByName(first_rows(more, key, n))


def unfinished(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no output yet."""
    return df.join(done.select(key), key, "left_anti")


def complete(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that raises if a left row has no match."""
    joined = left.join(right.withColumn("_hit", F.lit(True)), key, "left")
    return joined.withColumn("_hit", F.when(F.col("_hit"), True).otherwise(F.raise_error(F.concat(F.lit("no match for "), F.col(key).cast("string"))))).where("_hit").drop("_hit")


def without_leading(df: DataFrame, by: Sequence[str], order: Sequence[str], opens: Column, place: str) -> DataFrame:
    """df without the first row of each group, if that does not open it; the others' places run from 0."""
    w = Window.partitionBy(*by).orderBy(*order)
    first, n = F.first(F.coalesce(opens, F.lit(False))).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.row_number().over(w).cast("long")
    marked = df.withColumns({place: n, "_opens": first})
    dropped = (~F.col("_opens")).cast("long")
    return marked.where((F.col(place) > 1) | F.col("_opens")).withColumn(place, F.col(place) - 1 - dropped).drop("_opens")


def of_categories(answers: DataFrame, questions: DataFrame, key: str, category: str, wanted: Sequence[str]) -> DataFrame:
    """Answers, with the category of their question, whose question has one of the categories. Only such questions are shuffled."""
    return answers.join(questions.select(key, category).where(F.col(category).isin(*wanted)), key)


def with_caption_and_image(df: DataFrame, caption: str, images: Sequence[str], name: str = "image") -> DataFrame:
    """Rows with a caption and one of the images, of which the first is taken."""
    return df.withColumn(name, F.coalesce(*map(F.col, images))).where(F.col(caption).isNotNull() & F.col(name).isNotNull())


def missing_fields(df: DataFrame, names: Sequence[str]) -> Column:
    """An array of those of the required fields that are null, or texts without a character but blanks. A field that df does not have
    is missing from all rows."""
    kinds = dict(df.dtypes)
    lacks = [F.lit(True) if c not in kinds else (F.col(c).isNull() | (F.trim(c) == "")) if kinds[c] == "string" else F.col(c).isNull() for c in names]
    return F.filter(F.array(*[F.when(x, F.lit(c)) for c, x in zip(names, lacks, strict=True)]), lambda c: c.isNotNull())


def large_enough(width: Column, height: Column, least: int) -> Column:
    """valid: 1 if the shorter side has `least` pixels; 0 for smaller and for unreadable (null) images, whose rows stay."""
    return F.when(width.isNotNull() & height.isNotNull() & (F.least(width, height) >= least), 1).otherwise(0)


def rank_shards(df: DataFrame, order: Sequence[str], world: int, global_batch: int, fill_last: bool = False) -> DataFrame:
    """rank and place within it: contiguous shares of the rows by order. With fill_last the last batch is filled with the first rows."""
    n = df.count()
    fill = min(n, -n % global_batch) if fill_last else 0
    total = max(n + fill, 1)
    rows = running_number(df, order, "_pos")
    if fill:
        rows = rows.unionByName(rows.where(F.col("_pos") < fill).withColumn("_pos", F.col("_pos") + n))
    rank = F.floor(((F.col("_pos") + 1) * world - 1) / total).cast("long")
    rows = rows.withColumn("rank", rank)
    return rows.withColumn("place", F.col("_pos") - F.floor(F.col("rank") * total / world).cast("long")).drop("_pos")


def interleaved_index(i: Column, rank: Column, world: int, total: Column) -> Column:
    """The running number over all ranks of a rank's i-th sample, after `total` samples of the batches before."""
    return i * world + rank + total
