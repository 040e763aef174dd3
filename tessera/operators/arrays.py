"""Distributions, token filters, masks and maps in long form: one row a value, with the group's columns beside it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.common import fresh, placed


def softmax(x: Column, by: Sequence[str], temperature: float = 1.0) -> Column:
    """Shifted by the largest, so that no exponent overflows."""
    w = Window.partitionBy(*by)
    e = F.exp((x - F.max(x).over(w)) / temperature)
    return e / F.sum(e).over(w)


def with_softmax(df: DataFrame, x: str, by: Sequence[str], temperature: float = 1.0, name: str = "p") -> DataFrame:
    """For many small groups; a group is one task's."""
    w = Window.partitionBy(*by)
    shifted = df.withColumn("_e", F.exp((F.col(x) - F.max(x).over(w)) / temperature))
    return shifted.withColumn(name, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def _with_aggregates(df: DataFrame, by: Sequence[str], **aggregates: Column) -> DataFrame:
    """df with aggregates of its group: partial ones in every task, and a join with a row a group."""
    per = df.groupBy(*by).agg(*[v.alias(k) for k, v in aggregates.items()])
    theirs = fresh([*df.columns, *aggregates], *[f"_of{k}" for k in range(len(by))])
    same = F.lit(True)
    for c, o in zip(by, theirs, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(o))
    return df.join(per.withColumnsRenamed(dict(zip(by, theirs, strict=True))), same).drop(*theirs)


def with_softmax_of_few(df: DataFrame, x: str, by: Sequence[str], temperature: float = 1.0, name: str = "p") -> DataFrame:
    """The same for few groups of many rows: no task sees a whole group."""
    top, e, total = fresh(df.columns, "_top", "_e", "_total")
    shifted = _with_aggregates(df, by, **{top: F.max(x)}).withColumn(e, F.exp((F.col(x) - F.col(top)) / temperature)).drop(top)
    return _with_aggregates(shifted, by, **{total: F.sum(e)}).withColumn(name, F.col(e) / F.col(total)).drop(e, total)


def concentration(df: DataFrame, p: str, by: Sequence[str], order: str, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """Entropy, normalised entropy, mass of the k largest, and Gini coefficient of each group's values. Ranks are running numbers over
    ranges; the largest few come from a limit in each task."""
    ranked = placed(df.select(*by, p, order), by, [p, order], "_up")
    n, total = F.count("*"), F.sum(p)
    entropy = -F.sum(F.when(F.col(p) > 0, F.col(p) * F.log(p)).otherwise(0.0))
    gini = (2 * F.sum(F.col("_up") * F.col(p)) / total - (n + 1)) / n
    whole = ranked.groupBy(*by).agg(n.alias("n"), entropy.alias("entropy"), F.try_divide(entropy, F.log(n)).alias("normalised"), gini.alias("gini"))
    down = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(p), order))
    largest = df.select(*by, p, order).withColumn("_down", down).where(F.col("_down") <= max(ks))
    masses = largest.groupBy(*by).agg(*[F.sum(F.when(F.col("_down") <= k, F.col(p))).alias(f"top_{k}") for k in ks])
    theirs = [f"_of{k}" for k in range(len(by))]
    same = F.lit(True)
    for c, o in zip(by, theirs, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(o))
    return whole.join(masses.withColumnsRenamed(dict(zip(by, theirs, strict=True))), same).drop(*theirs)


def with_scaled(df: DataFrame, x: str, by: Sequence[str], name: str) -> DataFrame:
    """name: x brought to 0..1 within the group."""
    low, high = fresh([*df.columns, name], "_low", "_high")
    return _with_aggregates(df, by, **{low: F.min(x), high: F.max(x)}).withColumn(name, (F.col(x) - F.col(low)) / (F.col(high) - F.col(low) + 1e-8)).drop(low, high)


def otsu(df: DataFrame, value: str, by: Sequence[str], bins: int = 256) -> DataFrame:
    """threshold of each group (values in 0..1): the bin with the largest between-class variance, the first of equals.

    Only the histogram, at most `bins` rows a group, goes through the windows.
    """
    bin_ = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("long")
    counts = df.groupBy(*by, bin_.alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    upto = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    share = counts.withColumn("p", F.col("n") / F.sum("n").over(w)).withColumn("centre", (F.col("bin") + 0.5) / bins)
    sums = share.withColumns({"omega": F.sum("p").over(upto), "mu": F.sum(F.col("p") * F.col("centre")).over(upto), "total": F.sum(F.col("p") * F.col("centre")).over(w)})
    variance = F.try_divide(F.pow(F.col("total") * F.col("omega") - F.col("mu"), 2), F.col("omega") * (1 - F.col("omega")))
    scored = sums.withColumn("variance", F.round(F.when((F.col("omega") > 0) & (F.col("omega") < 1 - 1e-12), variance).otherwise(0.0), 9))
    best = F.row_number().over(w.orderBy(F.desc("variance"), "bin"))
    return scored.withColumn("_r", best).where("_r = 1").select(*by, F.col("centre").alias("threshold"), "variance")


def soft_mask(x: Column, threshold: Column, gamma: float) -> Column:
    return 1 / (1 + F.exp(-gamma * (x - threshold)))


def top_k_kept(x: str, by: Sequence[str], k: int) -> Column:
    """Values at least as large as the k-th: all that tie with it stay."""
    return F.rank().over(Window.partitionBy(*by).orderBy(F.desc(x))) <= k


def nucleus_kept(p: str, by: Sequence[str], order: str, top_p: float) -> Column:
    """Kept while the mass before does not exceed top_p; the largest always. Nulls come last, here and below."""
    w = Window.partitionBy(*by).orderBy(F.desc(p), F.asc_nulls_last(order)).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.round(F.sum(p).over(w), 9) <= top_p, F.lit(True))


def nucleus_kept_ascending(p: str, by: Sequence[str], order: str, top_p: float) -> Column:
    """The same from below: dropped while the mass up to and with the value is at most 1 - top_p."""
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_last(p), F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return F.round(F.sum(p).over(w), 9) > 1 - top_p


def min_p_kept(p: str, by: Sequence[str], share: float) -> Column:
    return F.col(p) >= share * F.max(p).over(Window.partitionBy(*by))


def penalised(logit: Column, count: Column, repetition: float, frequency: float, presence: float) -> Column:
    """Seen tokens: positive logits divided, others multiplied by the repetition penalty; then the other two are taken off."""
    once = F.when(count > 0, F.when(logit > 0, logit / repetition).otherwise(logit * repetition)).otherwise(logit)
    return once - frequency * count - presence * (count > 0).cast("int")


def beam_step(df: DataFrame, by: Sequence[str], width: int) -> DataFrame:
    """The 2 * width best (parent, token) of each group by cumulated log-probability."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("logp"), "parent", "token")).cast("long")
    return df.withColumn("place", rank).where(F.col("place") <= 2 * width)


def smoothed(grid: DataFrame, by: Sequence[str], x: str, y: str, value: str, sigma: float = 1.0, radius: int = 2) -> DataFrame:
    """Gaussian smoothing on a grid: each cell sends its weighted value to its neighbours; weights within the grid sum to 1."""
    offsets = [(dx, dy, float(np.exp(-(dx * dx + dy * dy) / (2 * sigma * sigma)))) for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1)]
    sent = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(w).alias("w")) for dx, dy, w in offsets])).alias("o")
    moved = grid.select(*by, x, y, value, sent).select(*by, (F.col(x) + F.col("o.dx")).alias(x), (F.col(y) + F.col("o.dy")).alias(y), (F.col(value) * F.col("o.w")).alias("_v"), F.col("o.w").alias("_w"))
    sums = moved.groupBy(*by, x, y).agg((F.sum("_v") / F.sum("_w")).alias("smooth"))
    return grid.join(sums, [*by, x, y])

