"""Sliding and running statistics over ordered rows, ordered folds, and runs of equal keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_rows(by: Sequence[str], order: Sequence[str], n: int):
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - n, 0)


def sliding(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str], n: int = 30) -> DataFrame:
    """median, mean, most, last of the last n rows, and the mean of all so far."""
    w = last_rows(by, order, n)
    all_ = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns(
        {"median": F.percentile(value, F.lit(0.5)).over(w), "mean": F.avg(value).over(w), "most": F.max(value).over(w), "latest": F.last(value).over(w), "global_mean": F.avg(value).over(all_)}
    )


def ema(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str], early: float = 0.9, late: float = 0.99, switch: int = 10) -> DataFrame:
    """n and the moving average of each group in its order; the first value is copied, the decay changes after `switch` steps.

    The last average is a weighted sum: a value's weight is its own share times the decays of all steps behind it, which its place
    and the number of steps tell. So it is an aggregate over placed rows, and no group is an array.
    """
    w = Window.partitionBy(*by)
    place = F.row_number().over(w.orderBy(*order)).cast("double") - 1
    rows = df.select(*by, F.col(value).cast("double").alias("_x"), place.alias("_i"), F.count("*").over(w).cast("double").alias("_n"))
    i, n = F.col("_i"), F.col("_n")
    own = F.when(i == 0, 1.0).when(i < switch, 1 - early).otherwise(1 - late)
    behind_early = F.greatest(F.least(n, F.lit(float(switch))) - (i + 1), F.lit(0.0))
    behind_late = F.greatest(n - F.greatest(i + 1, F.lit(float(switch))), F.lit(0.0))
    weight = own * F.pow(F.lit(early), behind_early) * F.pow(F.lit(late), behind_late)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(weight * F.col("_x")).alias("ema"))


def islands(df: DataFrame, key: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """island: number of the run of equal keys, from 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    fresh = F.coalesce((F.col(key) != F.lag(key).over(w)).cast("int"), F.lit(1))
    marked = df.withColumn("_new", fresh)
    return marked.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def addresses(df: DataFrame, length: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """start: sum of the lengths before."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("start", F.coalesce(F.sum(length).over(w), F.lit(0)))
