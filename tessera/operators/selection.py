"""Exact quantiles and weighted draws of whole tables, where no task or buffer holds all values.

An order statistic is found by counting passes: a sketch names two values near the wanted rank, one pass counts what is below and
at each, and only the values strictly between them (or beyond one of them) are still in question. A pass leaves a small share of
the values, and always fewer than before, whatever ties they hold; the last few are sorted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.common import fresh, hash_order, ranged

#: Values that are sorted in one buffer.
SMALL = 100_000
#: Accuracy of the sketch that names the next two values.
ACCURACY = 10_000
#: Groups that are searched in one pass.
TOGETHER = 16


@dataclass
class _Search:
    """A wanted rank (from 0) of a group: the n values strictly between low and high (None: without bound), below of all values
    before them."""

    group: object
    rank: int
    n: int
    low: float | None = None
    high: float | None = None
    below: int = 0
    found: float | None = None

    def inside(self, group: Column, value: Column) -> Column:
        is_in = group.eqNullSafe(F.lit(self.group)) & value.isNotNull()
        if self.low is not None:
            is_in = is_in & (value > F.lit(self.low))
        return is_in if self.high is None else is_in & (value < F.lit(self.high))


def _pass(df: DataFrame, group: Column, value: Column, wanted: list[_Search], small: int, accuracy: int) -> None:
    at = [s.inside(group, value) for s in wanted]
    asks = []
    for k, s in enumerate(wanted):
        mine, rank = F.when(at[k], value), s.rank - s.below
        if s.n <= small:
            asks.append(F.sort_array(F.collect_list(mine))[rank].alias(f"v{k}"))
        else:
            near = [min(max(rank / (s.n - 1) + d / accuracy, 0.0), 1.0) for d in (-2, 2)]
            asks.append(F.percentile_approx(mine, near, F.lit(accuracy)).alias(f"v{k}"))
    found = df.agg(*asks).first()
    still = []
    for k, s in enumerate(wanted):
        if s.n <= small:
            s.found = found[k]
        else:
            still.append((k, s, *found[k]))
    if not still:
        return
    tests = [F.count_if(at[k] & test).alias(f"c{k}_{j}") for k, _, a, b in still for j, test in enumerate((value < F.lit(a), value <= F.lit(a), value < F.lit(b), value <= F.lit(b)))]
    counts = df.agg(*tests).first()
    for i, (_, s, a, b) in enumerate(still):
        under_a, to_a, under_b, to_b = counts[4 * i : 4 * i + 4]
        rank = s.rank - s.below
        if under_a <= rank < to_a or under_b <= rank < to_b:
            s.found = a if rank < to_a else b
        elif rank < under_a:
            s.high, s.n = a, under_a
        elif rank < under_b:
            s.low, s.high, s.below, s.n = a, b, s.below + to_a, under_b - to_a
        else:
            s.low, s.below, s.n = b, s.below + to_b, s.n - to_b


def quantile(df: DataFrame, value: str, p: float, by: str | None = None, small: int = SMALL, accuracy: int = ACCURACY) -> DataFrame:
    """quantile (interpolated between neighbours) of each group's values, which are not null; groups without values have none.

    Groups of at most `small` values are sorted in buffers, as one aggregation; larger ones are searched, TOGETHER at a time.
    """
    spark = df.sparkSession
    name = by or fresh([value], "all")[0]
    rows = df.select((F.col(by) if by else F.lit(True)).alias(name), F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull())
    kind = rows.schema[name].dataType.simpleString()
    counts = rows.groupBy(name).agg(F.count("*").alias("n_values"))
    few = rows.join(counts.where(F.col("n_values") <= small).withColumnRenamed(name, "of"), F.col(name).eqNullSafe(F.col("of")), "left_semi")
    out = few.groupBy(name).agg(F.percentile(value, F.lit(p)).alias("quantile"))
    large = counts.where(F.col("n_values") > small).collect()  # at most one for each `small` rows
    got = []
    for k in range(0, len(large), TOGETHER):
        searches = {}
        for g in large[k : k + TOGETHER]:
            at = p * (g.n_values - 1)
            searches[g[name]] = (at, *[_Search(g[name], r, g.n_values) for r in (math.floor(at), math.ceil(at))])
        open_ = [s for _, a, b in searches.values() for s in (a, b)]
        while open_:
            _pass(rows, F.col(name), F.col(value), open_, small, accuracy)
            open_ = [s for s in open_ if s.found is None]
        got += [(g, a.found if a.rank == b.rank else (b.rank - at) * a.found + (at - a.rank) * b.found) for g, (at, a, b) in searches.items()]
    if got:
        out = out.unionByName(spark.createDataFrame(got, f"`{name}` {kind}, quantile double"))
    return out if by else out.select("quantile")


def weighted_draws(df: DataFrame, key: str, weight: str, n: int, seed: str) -> DataFrame:
    """n draws with replacement by weight: draw i takes the row whose range of cumulated weights, by key, holds its random number.

    Rows are laid out in ranges of the key; a draw finds its range among the ranges' sums, and its row among the cumulated
    weights of that range, by binary search. A range that many draws fall into is given to several tasks, each with a share of
    the draws: any number of rows and draws will do, and a row may have nearly all of the weight. Null weights and those that are
    not positive are never drawn.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(key).alias("key"), F.col(weight).cast("double").alias("weight")).where("weight > 0")
    kind = rows.schema["key"].dataType.simpleString()
    held = ranged(rows, ["key"], parts, "part", "at")
    sums = sorted(held.groupBy("part").agg(F.sum("weight").alias("w"), F.min("at").alias("at")).collect(), key=lambda r: r.part)  # a row a range
    total = sum(r.w for r in sums)
    if not total:
        return spark.createDataFrame([], f"draw long, `{key}` {kind}")
    bounds = np.cumsum([0.0] + [r.w for r in sums])
    tasks = np.array([max(1, math.ceil(len(sums) * r.w / total)) for r in sums])
    first = np.concatenate([[0], np.cumsum(tasks)])
    sent = spark.sparkContext.broadcast((bounds, tasks, first))

    def aimed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, tasks, first = sent.value
        for b in batches:
            draw, at = b.column(0).to_numpy(), b.column(1).to_numpy() * bounds[-1]
            part = np.clip(np.searchsorted(bounds, at, "right") - 1, 0, len(tasks) - 1)
            yield pa.RecordBatch.from_arrays([pa.array((first[part] + draw % tasks[part]).astype(np.int32)), pa.array(draw), pa.array(at - bounds[part])], names=["slot", "draw", "x"])

    unit = F.conv(F.substring(hash_order(seed, "draw"), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    draws = spark.range(n).select(F.col("id").alias("draw")).select("draw", unit.alias("u")).mapInArrow(aimed, "slot int, draw long, x double")
    slots = spark.createDataFrame([(r.part, int(first[k] + j)) for k, r in enumerate(sums) for j in range(tasks[k])], "part int, slot int")  # at most two a range
    both = held.join(F.broadcast(slots), "part").select("slot", F.lit(0).alias("kind"), "at", "key", F.col("weight").alias("x"))
    both = both.unionByName(draws.select("slot", F.lit(1).alias("kind"), F.col("draw").alias("at"), F.lit(None).cast(kind).alias("key"), "x"))

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[pa.RecordBatch] = []
        upto = keys = None
        for b in batches:
            cut = int(np.searchsorted(b.column(1).to_numpy(), 1))
            if cut:
                own.append(b.slice(0, cut))
            if cut < b.num_rows and own:
                if upto is None:
                    held = pa.Table.from_batches(own).combine_chunks()
                    keys, upto = held.column("key").combine_chunks(), np.cumsum(held.column("x").to_numpy())
                hit = np.minimum(np.searchsorted(upto, b.column(4).to_numpy()[cut:], "right"), len(upto) - 1)
                yield pa.RecordBatch.from_arrays([b.column(2).slice(cut), keys.take(pa.array(hit))], names=["draw", "key"])

    dealt = both.repartitionById(int(first[-1]), F.col("slot")).sortWithinPartitions("kind", "at")
    return dealt.mapInArrow(drawn, f"draw long, key {kind}").withColumnRenamed("key", key)

