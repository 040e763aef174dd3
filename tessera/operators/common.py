"""Orders, ranks and hashes that every other operator builds on. Every rank has a total order, so ties have one result."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


#: Bytes of a table, by Spark's estimate, that one task may sort.
SMALL_BYTES = 4 << 20


def cols(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in names]


def row_number(by: Sequence[str | Column], order: Sequence[str | Column]) -> Column:
    """Rank from 1 within the group, as a long."""
    w = Window.partitionBy(*cols(by)) if by else Window.partitionBy(F.lit(0))
    return F.row_number().over(w.orderBy(*cols(order))).cast("long")


def top_k(df: DataFrame, by: Sequence[str | Column], order: Sequence[str | Column], k: int = 1) -> DataFrame:
    """The first k rows of each group; Catalyst limits each partition's groups before the shuffle."""
    return df.withColumn("_rank", row_number(by, order)).where(F.col("_rank") <= k).drop("_rank")


def hash_order(seed: str, key: str | Column) -> Column:
    """A random order that any engine can repeat: the md5 of seed and key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def fresh(taken: Sequence[str], *names: str) -> list[str]:
    """The names, each lengthened until none of the taken ones (nor another of them) reads the same."""
    held, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def _has_map(kind: DataType) -> bool:
    return "map<" in kind.simpleString() or "variant" in kind.simpleString()


def ranged(df: DataFrame, order: Sequence[str | Column], n: int, part: str, at: str) -> DataFrame:
    """df laid out once as n ranges of the order, each row with its range and a number that rises within it.

    Equal keys are no unit: rows of one key are told apart by a hash of all they hold, and equal rows by their place in
    their part of the input, so that a key or a row that fills a third of the table is cut over as many ranges as any other
    third. The parts are sorted before places are given: a task that runs again gives each row the same place. (Maps cannot be
    hashed and are left out; rows that differ in maps alone count as equal.)
    """
    *keys, tie, place = fresh(df.columns, *[f"_k{i}" for i in range(len(order))], "_tie", "_place")
    held = [F.col(f"`{f.name}`") for f in df.schema.fields if not _has_map(f.dataType)]
    rows = df.select("*", *[c.alias(k) for c, k in zip(cols(order), keys, strict=True)], F.xxhash64(*held).alias(tie))
    rows = rows.sortWithinPartitions(*keys, tie).withColumn(place, F.monotonically_increasing_id())
    rows = rows.repartitionByRange(n, *keys, tie, place).sortWithinPartitions(*keys, tie, place).drop(*keys, tie, place)
    return laid_out(rows.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id()))


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "ord", start: int = 0) -> DataFrame:
    """A running number over the whole table without one task seeing every row, however many rows share a key.

    Rows are dealt out by ranges of the order and laid out once as files, each row with its range and place; each range is
    then moved by the sizes of those before. (Two runs of a range exchange need not cut at the same rows.)
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, at, first, before = fresh([*df.columns, name], "_part", "_at", "_from", "_before")
    dealt = ranged(df, order, n, part, at)
    sizes = dealt.groupBy(part).agg(F.count("*").alias(name), F.min(at).alias(first))
    moved = F.coalesce(F.sum(name).over(Window.partitionBy(F.lit(0)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = sizes.select(part, first, moved.alias(before))
    # a row a range, whose number is that of the shuffle's partitions
    return dealt.join(F.broadcast(places), part).withColumn(name, (F.col(at) - F.col(first) + F.col(before) + start).cast("long")).drop(part, at, first, before)


def running_number(df: DataFrame, order: Sequence[str | Column], name: str = "ord", start: int = 0) -> DataFrame:
    """numbered(), or one sorted task where the table is estimated to be at most SMALL_BYTES. The numbers are the same, up to equal rows."""
    if int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > SMALL_BYTES:
        return numbered(df, order, name, start)
    held = [F.col(f"`{f.name}`") for f in df.schema.fields if not _has_map(f.dataType)]
    return df.withColumn(name, row_number([], [*order, F.xxhash64(*held)]) + (start - 1))


def placed(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], name: str) -> DataFrame:
    """name: the place of a row in its group, from 1, without a task that sees a whole group: for few groups of many rows."""
    rows = running_number(df, [*by, *order], name)
    *theirs, first = fresh([*df.columns, name], *[f"_of{k}" for k in range(len(by))], "_first")
    starts = rows.groupBy(*by).agg(F.min(name).alias(first)).withColumnsRenamed(dict(zip(by, theirs, strict=True)))
    same = F.lit(True)
    for c, o in zip(by, theirs, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(o))
    return rows.join(starts, same).withColumn(name, F.col(name) - F.col(first) + 1).drop(first, *theirs)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset on one machine (tests), a new temporary folder."""
    kept = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not kept:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        kept = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.sparkContext.setCheckpointDir(kept)
    return kept.rstrip("/")


def laid_out(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again, so that all that follows sees the same rows in the same places."""
    path = f"{shared_folder(df.sparkSession)}/tables/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def r6(c: Column) -> Column:
    return F.round(c, 6)


def summed(x: str) -> Column:
    """The sum of a group's doubles, the same in whatever order they are added: exact where each value has at most 9 decimals
    (18 digits before them), else rounded to 9."""
    exact = F.col(x).try_cast("decimal(27,9)")
    whole = F.count_if(exact.cast("double") == F.col(x)) == F.count(x)
    return F.coalesce(F.when(whole, F.try_sum(exact).cast("double")), F.round(F.sum(x), 9))
