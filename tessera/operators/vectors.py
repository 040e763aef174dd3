"""Vectors: similarity, nearest neighbours, centroids, moments and distances of distributions.

Searches send the queries' side in blocks to the rows' partitions (a stated query set against all rows), so that no pair
leaves a task but the best of each query. Blocks are bounded by rows, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.common import laid_out, numbered
from tessera.operators.screens import ROWS, Screen, blocks_of, meet

#: Numbers of a codebook that are sent to the executors at once: 64 MB.
BOOK_NUMBERS = 8_000_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def nearest(rows: DataFrame, queries: DataFrame, k: int, key: str, vector: str, by: str = "cosine", block: int = 0, parts: int = 0) -> DataFrame:
    """query, id, measure, rank of the k nearest rows of each query but itself; ties go to the smaller id.

    Rows are dealt into parts, queries into blocks; every (part, block) yields the k best of each query, and these are
    merged. Shuffled are the rows once a block and the queries once a part. A task holds one part, and compares it with a batch of
    queries at a time. Vectors that are null, or that have no measure, are nobody's neighbours.
    """
    rows = rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    queries = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    count, tasks = queries.count(), rows.sparkSession.sparkContext.defaultParallelism
    parts = parts or max(1, -(-rows.count() // ROWS))
    blocks = -(-max(1, count) // block) if block else blocks_of(count, parts, tasks)
    cosine = by == "cosine"

    def ready(v: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore"):
            return v / np.linalg.norm(v, axis=1, keepdims=True) if cosine else v

    def make(ids: np.ndarray, v: np.ndarray, limit: np.ndarray) -> Screen:
        v = ready(v)
        some = np.isfinite(v).all(1)
        return Screen(ids[some], v[some], inner=cosine)

    def best(part: Screen, names: np.ndarray, v: np.ndarray, bound: np.ndarray, slope: np.ndarray) -> pa.RecordBatch:
        v = ready(v)
        some = np.isfinite(v).all(1)
        names = names[some]
        at, ids, far = part.nearest(names, v[some], k, bound[some]) if len(part.ids) and len(names) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.RecordBatch.from_arrays([pa.array(names[at]), pa.array(ids), pa.array(far)], names=["query", "id", "measure"])

    of = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("part", of(parts)).withColumn("block", each(blocks)).withColumn("limit", F.lit(None).cast("double"))
    right = queries.withColumn("block", of(blocks)).withColumn("part", each(parts)).withColumns({"bound": F.lit(None).cast("double"), "slope": F.lit(0.0)})
    found = meet(left, right, make, best, "query long, id long, measure double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("measure", "id")).cast("long")
    out = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return out.withColumn("measure", -F.col("measure")) if cosine else out


def positions(df: DataFrame, vector: str, *keep: str) -> DataFrame:
    """Long form: pos and value of each component."""
    return df.select(*keep, F.posexplode(vector).alias("pos", "value"))


def centroids(df: DataFrame, by: str, vector: str, unit: bool = True) -> DataFrame:
    """Mean of the (unit) vectors of each group, made a unit vector again."""
    # the norm is a column below the generator, so it is computed once a row
    long = positions(df.select(by, F.col(vector).alias("v"), (norm(F.col(vector)) if unit else F.lit(1.0)).alias("size")), "v", by, "size")
    means = long.groupBy(by, "pos").agg(F.avg(F.col("value") / F.col("size")).alias("value"))
    if unit:
        sizes = means.groupBy(by).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("size"))
        means = means.join(sizes, by).select(by, "pos", (F.col("value") / F.col("size")).alias("value"))
    return means.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("centroid"))


def assigned(df: DataFrame, book: DataFrame, code: str, vector: str, by: str = "cosine") -> DataFrame:
    """df with the code whose centroid has the largest cosine (the smallest code of equals); null vectors get none. By "l2" it is the
    one of the least squared distance, by "unit l2" that of unit vectors; the score is then its negative.

    Rows meet the codebook in one matrix product a batch. It is sent to the executors in parts of at most BOOK_NUMBERS
    numbers, so a codebook of any size takes bounded memory and no shuffle of the rows.
    """
    width, total = book.select(F.max(F.size("centroid")), F.count("*")).first()
    per = max(1, BOOK_NUMBERS // max(width or 1, 1))
    rows = laid_out(numbered(book.select(F.col(code).cast("long").alias("code"), "centroid"), ["code"], "place")) if total > per else book.select(F.col(code).cast("long").alias("code"), "centroid", F.lit(0).cast("long").alias("place"))
    out = df.withColumns({"code": F.lit(None).cast("long"), "score": F.lit(None).cast("double")})
    for at in range(0, max(total, 1), per):
        part = rows.where((F.col("place") >= at) & (F.col("place") < at + per)).select("code", "centroid").orderBy("code").collect()  # at most `per` codes
        if part:
            sent = df.sparkSession.sparkContext.broadcast((np.array([r["code"] for r in part], np.int64), np.array([r["centroid"] for r in part], float)))
            out = out.mapInArrow(_nearest_code(sent, vector, by), out.schema)
    return out


def _nearest_code(sent, vector: str, by: str):
    unit = lambda m: m / np.sqrt((m**2).sum(1))[:, None]

    def scored(x: np.ndarray, book: np.ndarray) -> np.ndarray:
        if by == "cosine":
            return x @ unit(book).T / np.sqrt((x**2).sum(1))[:, None]
        if by == "unit l2":
            x, book = unit(x), unit(book)
        return 2 * x @ book.T - (x**2).sum(1)[:, None] - (book**2).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, book = sent.value
        for b in batches:
            names = b.schema.names
            col, had, was = (b.column(names.index(c)) for c in (vector, "code", "score"))
            some = np.flatnonzero(col.is_valid().to_numpy(zero_copy_only=False))
            new_code, new_score = had.to_pylist(), was.to_pylist()
            if len(some):
                x = col.drop_null().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(some), -1)
                scores = np.round(scored(x, book), 9)
                best = scores.argmax(1)
                for k, c, s in zip(some.tolist(), codes[best].tolist(), scores[np.arange(len(some)), best].tolist(), strict=True):
                    if new_score[k] is None or s > new_score[k]:
                        new_code[k], new_score[k] = c, s
            cols = list(b.columns)
            cols[names.index("code")], cols[names.index("score")] = pa.array(new_code, pa.int64()), pa.array(new_score, pa.float64())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def moments(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance (n - 1): each batch adds its sums, so only d x d numbers a partition are gathered."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, ss = 0, None, None
        for b in batches:
            if len(b):
                x = np.stack(b["v"]).astype(float)
                n, s, ss = n + len(x), x.sum(0) + (0 if s is None else s), x.T @ x + (0 if ss is None else ss)
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "ss": [ss.ravel().tolist()]})

    parts = df.select(F.col(vector).alias("v")).mapInPandas(sums, "n long, s array<double>, ss array<double>")
    long = parts.select(F.posexplode(F.concat(F.array(F.col("n").cast("double")), "s", "ss")).alias("pos", "x"))
    x = np.array([r["x"] for r in long.groupBy("pos").agg(F.sum("x").alias("x")).orderBy("pos").collect()])
    n, x = (int(x[0]), x[1:]) if len(x) else (0, x)
    d = int(round((-1 + np.sqrt(1 + 4 * len(x))) / 2))
    mean = x[:d] / max(n, 1)
    return n, mean, (x[d:].reshape(d, d) - n * np.outer(mean, mean)) / max(n - 1, 1)


def frechet(m1: np.ndarray, c1: np.ndarray, m2: np.ndarray, c2: np.ndarray) -> float:
    """Squared distance of the means, plus the traces, minus twice the trace of the root of the covariances' product."""
    values, vectors = np.linalg.eigh(c1)
    root = (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T
    cross = np.sqrt(np.maximum(np.linalg.eigvalsh(root @ c2 @ root), 0)).sum()
    return float(((m1 - m2) ** 2).sum() + np.trace(c1) + np.trace(c2) - 2 * cross)


def inception(df: DataFrame, probabilities: str, split: str) -> DataFrame:
    """exp of the mean divergence of each row's distribution from its split's mean, by split."""
    long = df.select(F.col(split).alias("split"), "id", F.posexplode(probabilities).alias("pos", "p"))
    mean = F.avg("p").over(Window.partitionBy("split", "pos"))
    rows = long.withColumn("kl", F.when(F.col("p") > 0, F.col("p") * (F.log("p") - F.log(mean))).otherwise(0.0))
    per = rows.groupBy("split", "id").agg(F.sum("kl").alias("kl"))
    return per.groupBy("split").agg(F.exp(F.avg("kl")).alias("score"))


def entropy_loss(df: DataFrame, book: np.ndarray, vector: str, sharpness: float) -> float:
    """Mean entropy of the rows' softmax over the codes (by squared distance), minus the entropy of the mean softmax."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, own, probs = 0, 0.0, np.zeros(len(book))
        for b in batches:
            for at in range(0, len(b), 1024):
                x = np.stack(b[vector].iloc[at : at + 1024].to_numpy()).astype(float)
                z = -sharpness * ((x**2).sum(1, keepdims=True) + (book**2).sum(1) - 2 * x @ book.T)
                z -= z.max(1, keepdims=True)
                log_p = z - np.log(np.exp(z).sum(1, keepdims=True))
                p = np.exp(log_p)
                n, own, probs = n + len(x), own - (p * log_p).sum(), probs + p.sum(0)
        yield pd.DataFrame({"n": [n], "own": [own], "probs": [probs]})

    parts = df.select(vector).where(F.col(vector).isNotNull()).mapInPandas(run, "n long, own double, probs array<double>").collect()  # a row a task
    n = sum(r.n for r in parts)
    if not n:
        return float("nan")
    mean = sum(np.array(r.probs) for r in parts) / n
    return float(sum(r.own for r in parts) / n + (mean * np.log(mean + 1e-7)).sum())
