"""Approximate nearest neighbours by cosine with an inverted multi-index.

Unit vectors are cut in two halves and each half is quantised by its own codebook, so k + k centroids make k * k cells.
A query visits cells in the order of the summed distances of their two centroids, found with a heap, until they hold
`visit` of all vectors; the vectors of these cells are reranked by the exact cosine of the original vectors in double
precision.

Codebooks are fitted on a sample of at most SAMPLE vectors (by a hash of the id); every vector is indexed. Cells are
dealt into buckets of about `bucket_rows` vectors, and a cell that holds more is split over several, so a cell with a
third of all vectors is shared out. Vectors are shuffled once, queries go to the buckets that hold their cells, and a task
holds the vectors of one bucket while the bucket's queries pass by in batches.

Vectors that are null, of another length than most, zero, or hold null or non-finite components take no part. Rows that
repeat an id count as one. Ties go to the smaller id; a query with fewer than k other vectors gets all of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import column, stored

SAMPLE = 16_384
#: Queries whose cells one task looks up.
ROUTED = 128
#: Queries that are multiplied with a bucket at once, pairs scored at once, and more than products of unit vectors differ by rounding.
PRODUCTS = 64
SCORED = 65_536
ROUNDING = 1e-9


def usable(col: str) -> Column:
    v = F.col(col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    centres = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        near = (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        empty = n == 0
        sums[empty], n[empty] = x[rng.choice(len(x), int(empty.sum()))], 1
        centres = sums / n[:, None]
    return centres


def cells_in_order(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) by ascending left[i] + right[j], by the multi-sequence algorithm."""
    a, b = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    heap = [(float(left[a[0]] + right[b[0]]), 0, 0)]
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(a[i]), int(b[j])
        if i + 1 < len(a):  # each pair is pushed once: along the first row by its left neighbour, else from above
            heapq.heappush(heap, (float(left[a[i + 1]] + right[b[j]]), i + 1, j))
        if i == 0 and j + 1 < len(b):
            heapq.heappush(heap, (float(left[a[0]] + right[b[j + 1]]), 0, j + 1))


def _matrix(col: pa.Array) -> np.ndarray:
    """Vectors of one length without nulls as rows."""
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), len(flat) // max(1, len(col)))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # tiny and huge vectors do not lose their norm
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    cells: int = 64,
    visit: float = 0.55,
    bucket_rows: int = 8192,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each row for which is_query holds."""
    schema = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    good = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q")).where(
        F.col("vec_id").isNotNull() & usable("v")
    )
    sizes = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    dim = sizes[0]["d"]
    good = good.where(F.size("v") == dim).dropDuplicates(["vec_id"])
    sample = _unit(np.array([r["v"] for r in good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()], np.float64))
    half = max(1, dim // 2)
    books = (kmeans(sample[:, :half], cells), kmeans(sample[:, half:] if dim > 1 else np.zeros((len(sample), 1)), cells))
    width = len(books[1])
    sent = spark.sparkContext.broadcast(books)

    def halves(x: np.ndarray) -> list[np.ndarray]:
        u = _unit(x)
        parts = (u[:, :half], u[:, half:] if dim > 1 else np.zeros((len(u), 1)))
        return [(p**2).sum(1)[:, None] - 2 * p @ c.T + (c**2).sum(1) for p, c in zip(parts, sent.value, strict=True)]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                a, c = halves(_matrix(column(b, "v")))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(a.argmin(1) * width + c.argmin(1), pa.int64())], names=[*b.schema.names, "cell"])

    index = stored(good.mapInArrow(assign, "vec_id long, v array<double>, q boolean, cell long"), "multi-index")
    counts = np.zeros(len(books[0]) * width, np.int64)
    for r in index.groupBy("cell").count().collect():  # at most cells * cells
        counts[r["cell"]] = r["count"]
    total = int(counts.sum())
    first, parts = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    bucket, room = 0, bucket_rows
    for c in np.flatnonzero(counts):
        if counts[c] > room:
            bucket, room = bucket + 1, bucket_rows
        first[c] = bucket
        if counts[c] > bucket_rows:
            parts[c] = -(-counts[c] // bucket_rows)
            bucket, room = bucket + parts[c], bucket_rows
        else:
            room -= counts[c]
    queries = index.where("q")
    routes = max(1, -(-queries.count() // ROUTED))
    placed = spark.sparkContext.broadcast((counts, first, parts))
    want = max(k + 1, int(np.ceil(visit * total)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, first, parts = placed.value
        for b in batches:
            cell, ids = column(b, "cell").to_numpy(), column(b, "vec_id").to_numpy()
            salt = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts[cell]
            yield pa.RecordBatch.from_arrays([column(b, "vec_id"), column(b, "v"), column(b, "cell"), pa.array(first[cell] + salt)], names=["vec_id", "v", "cell", "bucket"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, first, parts = placed.value
        names = ["query_id", "qv", "bucket", "visits"]
        for b in batches:
            if not b.num_rows:
                continue
            left, right = halves(_matrix(column(b, "v")))
            for n, (qid, v) in enumerate(zip(column(b, "vec_id").to_pylist(), column(b, "v").to_pylist(), strict=True)):
                held, by = 0, {}
                for i, j in cells_in_order(left[n], right[n]):
                    c = i * width + j
                    if counts[c]:
                        for x in range(int(first[c]), int(first[c] + parts[c])):
                            by.setdefault(x, []).append(c)
                        held += int(counts[c])
                        if held >= want:
                            break
                yield pa.RecordBatch.from_arrays(
                    [pa.array([qid] * len(by), pa.int64()), pa.array([v] * len(by), pa.list_(pa.float64())), pa.array(list(by), pa.int64()), pa.array(list(by.values()), pa.list_(pa.int64()))],
                    names=names,
                )

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by bucket, its vectors before its queries."""
        at, held, index_of = None, [], None
        for b in batches:
            bucket = column(b, "bucket").to_numpy()
            asks = column(b, "asks").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (asks[1:] != asks[:-1])]))
            for s, e in zip(cuts.tolist(), np.append(cuts[1:], b.num_rows).tolist(), strict=True):
                part = b.slice(s, e - s)
                if bucket[s] != at:
                    at, held, index_of = bucket[s], [], None
                if not asks[s]:
                    held.append(part)
                elif held:
                    index_of = index_of or _Bucket(held)
                    yield index_of.nearest(part, k)

    rows = index.select("vec_id", "v", "cell").mapInArrow(place, "vec_id long, v array<double>, cell long, bucket long")
    rows = rows.select("bucket", F.lit(False).alias("asks"), F.col("vec_id").alias("id"), "v", "cell", F.lit(None).cast("array<long>").alias("visits"))
    asked = queries.select("vec_id", "v").repartition(routes, F.xxhash64("vec_id")).mapInArrow(route, "query_id long, qv array<double>, bucket long, visits array<long>")
    asked = asked.select("bucket", F.lit(True).alias("asks"), F.col("query_id").alias("id"), F.col("qv").alias("v"), F.lit(None).cast("long").alias("cell"), "visits")
    met = rows.unionByName(asked).repartition("bucket").sortWithinPartitions("bucket", "asks")
    near = met.mapInArrow(rerank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class _Bucket:
    """The vectors of a bucket by cell."""

    def __init__(self, parts: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(parts)
        cell = rows.column("cell").to_numpy()
        order = np.argsort(cell, kind="stable")
        self.u = _unit(np.concatenate([_matrix(column(p, "v")) for p in parts])[order])
        self.ids = rows.column("id").to_numpy()[order]
        self.cells, self.cell = np.unique(cell[order], return_inverse=True)

    def nearest(self, asked: pa.RecordBatch, k: int) -> pa.RecordBatch:
        """The k best of the visited cells for each query: products of a block of queries leave out what cannot be among them by more
        than rounding, and the rest is scored and ordered vector by vector, so equal vectors have equal scores."""
        ids, visits = column(asked, "id").to_numpy(), column(asked, "visits")
        q = _unit(_matrix(column(asked, "v")))
        found = []
        for s in range(0, len(ids), PRODUCTS):
            block = q[s : s + PRODUCTS]
            lists = visits.slice(s, len(block))
            visited = np.zeros((len(block), len(self.cells)), bool)
            cell, of = lists.flatten().to_numpy(), np.repeat(np.arange(len(block)), lists.value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)
            here = self.cells[at] == cell
            visited[of[here], at[here]] = True
            near = block @ self.u.T
            near[~visited[:, self.cell] | (self.ids == ids[s : s + PRODUCTS, None])] = -np.inf
            last = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(block), -np.inf)
            row, col = np.nonzero((near >= last[:, None] - ROUNDING) & (near > -np.inf))
            score = np.empty(len(row))
            for t in range(0, len(row), SCORED):  # many may tie
                score[t : t + SCORED] = np.einsum("nd,nd->n", block[row[t : t + SCORED]], self.u[col[t : t + SCORED]])
            order = np.lexsort((self.ids[col], -score, row))
            row, col, score = row[order], col[order], score[order]
            best = np.arange(len(row)) - np.searchsorted(row, row) < k
            found.append((ids[s + row[best]], self.ids[col[best]], score[best]))
        names = ["query_id", "vec_id", "score"]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=names)
