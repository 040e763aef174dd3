"""Comparing blocks of queries with parts of rows: one product in single precision leaves few pairs, which are measured in double.

The error of a product in single precision has an upper bound that follows from the lengths of the vectors, so no pair within the
wanted measure is lost. Where more than FULL of the pairs are left (copies, or nothing known yet), all are measured in double.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a part and of a block of queries: a task holds a part and a batch, and each vector is sent once a block or part.
ROWS = 32_768
#: Pairs of a batch of queries and a part.
BATCH_PAIRS = 4 << 20
#: Pairs measured in double at once, and the share of pairs from which on all are.
PAIRS, FULL = 1 << 16, 0.02
#: Measures are rounded to so many decimals, so that equal vectors tie.
DECIMALS = 12
#: Rows of which only the best is looked at to bound the k-th best.
STRIDE = 64


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of each of a to each of b, by one matrix product."""
    d = a @ b.T
    d *= -2
    d += (a**2).sum(1)[:, None]
    d += (b**2).sum(1)
    return np.round(np.maximum(d, 0, out=d), DECIMALS, out=d)


def matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)


def few(mask: np.ndarray, most: int) -> np.ndarray | None:
    """The flat places of a contiguous mask that are true, eight looked at together; None, if they are more than `most`."""
    flat = mask.reshape(-1)
    whole = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:whole].view(np.uint64))
    if len(words) > most:
        return None
    at = (words[:, None] * 8 + np.arange(8)).reshape(-1)
    found = np.concatenate([at[flat[at]], whole + np.flatnonzero(flat[whole:])])
    return None if len(found) > most else found


class Screen:
    """The rows of a part in the order of their ids. Measures are squared distances, or negative inner products."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, limit: np.ndarray | None = None, inner: bool = False):
        order = np.argsort(ids, kind="stable")
        self.ids, self.v, self.inner = ids[order], v[order], inner
        self.limit = None if limit is None else limit[order]
        squares = (self.v**2).sum(1)
        # a row's limit, times a query's slope, is taken off
        ends = np.stack([np.zeros(len(v)) if inner else squares, np.zeros(len(v)) if limit is None else np.nan_to_num(self.limit, posinf=np.inf)], 1)
        with np.errstate(over="ignore"):
            self.single = np.ascontiguousarray(np.concatenate([self.v, ends], 1).astype(np.float32).T)
        self.sound = bool(np.isfinite(self.single).all())
        self.longest, self.widest = float(np.sqrt(squares.max(initial=0))), float(np.abs(ends[:, 1]).max(initial=0))

    def measured(self, q: np.ndarray, every: int = 1) -> np.ndarray:
        """Each query with each row (or one of so many), in double."""
        v = self.v[::every]
        return np.round(-(q @ v.T), DECIMALS) if self.inner else distances(q, v)

    def pairs(self, q: np.ndarray, at: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Query at[i] with row[i], in double."""
        out = np.empty(len(at))
        for s in range(0, len(at), PAIRS):
            a, b = q[at[s : s + PAIRS]], self.v[row[s : s + PAIRS]]
            d = np.einsum("ij,ij->i", a, b)
            d = -d if self.inner else np.maximum(np.einsum("ij,ij->i", a, a) + np.einsum("ij,ij->i", b, b) - 2 * d, 0)
            out[s : s + PAIRS] = np.round(d, DECIMALS)
        return out

    def within(self, q: np.ndarray, bound: np.ndarray, slope: np.ndarray, k: int | None = None) -> tuple[np.ndarray, np.ndarray] | None:
        """Queries and rows of all pairs whose measure is at most bound + slope * the row's limit (and which may be among the query's k
        best and one more), with a few beyond; or None, where they are too many or not bounded."""
        known = np.isfinite(bound) & np.isfinite(slope)
        strides = self.single.shape[1] // STRIDE
        if not self.sound or not len(q) or (k is None or strides <= k) and not known.all():
            return None
        slope = np.where(known, slope, 0)
        squares = (q**2).sum(1)
        with np.errstate(over="ignore", invalid="ignore"):
            scores = np.concatenate([(-1 if self.inner else -2) * q, np.ones((len(q), 1)), -slope[:, None]], 1).astype(np.float32) @ self.single
        error = (q.shape[1] + 16) * 2.0**-23 * (2 * np.sqrt(squares) * self.longest + self.longest**2 + slope * self.widest) + 4 * 10.0**-DECIMALS
        top = np.where(known, bound if self.inner else bound - squares, np.inf)
        if k is not None and strides > k and not known.all():
            best = scores[:, : strides * STRIDE].reshape(len(q), STRIDE, strides).min(1)
            top = np.minimum(top, np.partition(best, k, axis=1)[:, k] + error)
        top = np.nextafter((top + error).astype(np.float32), np.float32(np.inf))
        # an overflow has no order, and is then left to doubles
        if not np.isfinite(top).all():
            return None
        found = few(~(scores > top[:, None]), int(FULL * scores.size))
        return None if found is None else np.divmod(found, scores.shape[1])

    def nearest(self, names: np.ndarray, q: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the query, id and measure of the k rows of the least measure that do not have its name, ties by id; those above the
        bound may lack."""
        left = self.within(q, bound, np.zeros(len(q)), k)
        if left is None:
            d = self.measured(q)
            d[(names[:, None] == self.ids) | np.isnan(d)] = np.inf
            at, row, far = (np.empty((len(q), min(k, d.shape[1])), t) for t in (np.int64, np.int64, float))
            every = np.arange(len(q))
            for r in range(at.shape[1]):  # the first of equals has the smallest id
                best = d.argmin(1)
                at[:, r], row[:, r], far[:, r] = every, best, d[every, best]
                d[every, best] = np.inf
            keep = np.isfinite(far)
            return at[keep], self.ids[row[keep]], far[keep]
        at, row = left
        other = names[at] != self.ids[row]
        at, row = at[other], row[other]
        far = self.pairs(q, at, row)
        order = np.lexsort((row, far, at))
        at, row, far = at[order], row[order], far[order]
        starts = np.searchsorted(at, np.arange(len(q)))
        keep = (np.arange(len(at)) - starts[at] < k) & np.isfinite(far)
        return at[keep], self.ids[row[keep]], far[keep]


def blocks_of(queries: int, parts: int, tasks: int) -> int:
    """Blocks of at most ROWS queries; more where cells would be fewer than tasks, as long as a block has an eighth of ROWS."""
    return max(1, -(-queries // ROWS), min(-(-queries // (ROWS // 8)), -(-2 * tasks // max(1, parts))))


def meet(rows: DataFrame, asks: DataFrame, make: Callable, look: Callable, schema: str, blocks: int | None = None) -> DataFrame:
    """look(make(the cell's rows), a batch of its asks) for each cell (part, block) of both, in tasks that hold one cell's rows.
    Where the number of blocks is told, cells are dealt out in turn; by a hash, several may meet in one task while others have none.

    rows: part, block, id, v, limit. asks: part, block, id, v, bound, slope.
    """
    rows = rows.select("part", "block", F.lit(0).alias("kind"), "id", "v", F.col("limit").alias("bound"), F.lit(None).cast("double").alias("slope"))
    asks = asks.select("part", "block", F.lit(1).alias("kind"), "id", "v", "bound", "slope")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(k).to_numpy() for k in range(3)])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if (keys[0, s], keys[1, s]) != cell:
                    cell, held = (keys[0, s], keys[1, s]), []
                if keys[2, s] == 0:
                    held.append(b.slice(s, e - s))
                    continue
                if isinstance(held, list):
                    if not held:
                        continue
                    t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held = make(t.column(3).to_numpy(), matrix(t.column(4)), t.column(5).to_numpy(zero_copy_only=False).astype(float))
                step = max(1, BATCH_PAIRS // max(1, len(held.ids)))
                for at in range(s, e, step):
                    a = b.slice(at, min(step, e - at))
                    numbers = [a.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (5, 6)]
                    yield look(held, a.column(3).to_numpy(), matrix(a.column(4)), *numbers)

    both = rows.unionByName(asks)
    if blocks is None:
        dealt = both.repartition("part", "block")
    else:
        spark = both.sparkSession
        n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        dealt = both.repartitionById(n, F.pmod(F.col("part") * blocks + F.col("block"), F.lit(n)).cast("int"))
    return dealt.sortWithinPartitions("part", "block", "kind").mapInArrow(run, schema)
