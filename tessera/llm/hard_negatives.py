"""Hard negatives: for each anchor and each of its nearest rows of the same label, the rows of other labels that come just below.

Components are quantised to floor(256 * x), so that scores are integers and have no order of summation. All rows are dealt out
over parts of bounded size; each part ranks all of its rows for each anchor. The anchors, a stated set, pass by each part in
batches: no vector is sent to the driver or broadcast, and a part holds its own rows only.

First pass: the part's rows of the anchor's label are sorted by score and id; the best of all parts are the positives. Second
pass: the part's rows of other labels are sorted by score and id (rows stand in the order of their ids, so a stable sort by
score is the sort by both); each positive's upper limit is looked up by binary search, and from there the first k at or above the
lower limit are read. The first k of all parts' are the result.

Work is the number of anchors times that of rows, as the ranking asks; what is shuffled is each anchor once a part and at
most k rows for each anchor, positive and part.

Edge cases: rows with a null id, label or vector, or a null or non-finite component take no part. Rows that repeat an id count each
for itself: they are each other's positives, and each anchor of an id has its own ranks. Components that a shorter vector lacks
count 0. Scores that may not fit 64 bits are refused. An anchor without positives or negatives has no rows. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import column, stored

#: Numbers in the vectors of a part, and scores of a batch of anchors against a part.
PART_NUMBERS = 4 << 20
BATCH_SCORES = 2 << 20
SCALE = 256


def prepared(df: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """row, vec_id, label, q (array<long>), anchor of the rows that take part; row tells them apart, once they are stored."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & finite
    q = F.transform(vector_col, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    own = df.where(good).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), q.alias("q"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    return own.withColumn("row", F.monotonically_increasing_id())


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, exactly: in doubles where all sums are whole numbers below 2**53, else in 64 bits."""
    bound = a.shape[1] * float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0))
    if bound < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if bound < 2**63:
        return a @ b.T
    raise OverflowError("scores may not fit 64 bits")


def by_length(vectors: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length the matrix of its vectors, and their places."""
    lengths = vectors.value_lengths().to_numpy()
    flat, starts = vectors.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lengths)])
    places = [np.flatnonzero(lengths == n) for n in np.unique(lengths)]
    return [(flat[starts[at][:, None] + np.arange(lengths[at[0]])], at) for at in places]


class Part:
    """The rows of a part in the order of their ids."""

    def __init__(self, batches: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(batches).sort_by([("vec_id", "ascending"), ("row", "ascending")]).combine_chunks().to_batches()[0]
        self.row, self.ids, self.labels = (column(rows, c).to_numpy() for c in ("row", "vec_id", "label"))
        self.blocks = by_length(column(rows, "q"))

    def scores(self, vectors: pa.Array) -> np.ndarray:
        """The integer product of each of the vectors with each row."""
        out = np.empty((len(vectors), len(self.ids)), np.int64)
        for q, mine in by_length(vectors):
            for block, at in self.blocks:
                n = min(q.shape[1], block.shape[1])
                out[np.ix_(mine, at)] = product(q[:, :n], block[:, :n])
        return out


def _sorted(scores: np.ndarray) -> np.ndarray:
    """Places by falling score; rows stand by id, so that a stable sort by score is the sort by score and id."""
    return np.argsort(-scores, kind="stable")


POSITIVES = "anchor_row long, row long, vec_id long, score long"


def _positives(k: int) -> Callable:
    def ask(part: Part, asks: pa.RecordBatch) -> pa.RecordBatch:
        scores, own, labels = part.scores(column(asks, "q")), column(asks, "row").to_numpy(), column(asks, "label").to_numpy()
        out = []
        for i in range(len(own)):
            at = np.flatnonzero((part.labels == labels[i]) & (part.row != own[i]))
            best = at[_sorted(scores[i, at])[:k]]
            out.append((np.full(len(best), own[i]), part.row[best], part.ids[best], scores[i, best]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["anchor_row", "row", "vec_id", "score"])

    return ask


NEGATIVES = "anchor_row long, anchor_id long, positive_row long, positive_id long, positive_score long, row long, negative_id long, negative_score long"
_NAMES = [c.split()[0] for c in NEGATIVES.split(", ")]


def _negatives(k: int, low: int, high: int) -> Callable:
    def ask(part: Part, asks: pa.RecordBatch) -> pa.RecordBatch:
        scores, labels = part.scores(column(asks, "q")), column(asks, "label").to_numpy()
        out = []
        for i, (row, anchor, positives) in enumerate(zip(*[column(asks, c).to_pylist() for c in ("row", "vec_id", "limits")], strict=True)):
            at = np.flatnonzero(part.labels != labels[i])
            at = at[_sorted(scores[i, at])]
            falling = -scores[i, at]
            for p in positives:
                start = int(np.searchsorted(falling, -(high * p["score"] // 100), "left"))
                stop = int(np.searchsorted(falling, low * -p["score"] // 100, "right"))  # the lower limit, rounded up, negated
                read = at[start : min(stop, start + k)]
                given = [np.full(len(read), v, np.int64) for v in (row, anchor, p["row"], p["vec_id"], p["score"])]
                out.append((*given, part.row[read], part.ids[read], scores[i, read]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=_NAMES)

    return ask


LIMITS = "array<struct<row: bigint, vec_id: bigint, score: bigint>>"


def _by_parts(rows: DataFrame, asks: DataFrame, parts: int, ask: Callable, schema: str) -> DataFrame:
    """What ask finds in each part for each of the asks (row, vec_id, label, q, limits)."""
    own = rows.select(F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("kind"), "row", "vec_id", "label", "q", F.lit(None).cast(LIMITS).alias("limits"))
    sent = asks.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("kind"), "row", "vec_id", "label", "q", "limits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        part = None
        for b in batches:
            cut = int(np.searchsorted(column(b, "kind").to_numpy(), 1))
            if cut:
                held.append(b.slice(0, cut))
            if cut < b.num_rows and held:
                part = part or Part(held)
                step = max(1, BATCH_SCORES // len(part.ids))
                for s in range(cut, b.num_rows, step):
                    yield ask(part, b.slice(s, step))

    return own.unionByName(sent).repartitionById(parts, F.col("part")).sortWithinPartitions("kind").mapInArrow(run, schema)


def _first(df: DataFrame, by: list[str], score: str, id_col: str, k: int) -> DataFrame:
    """The first k of each group by falling score and rising id, with their rank."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), id_col, "row")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mined(df: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. A negative's score is between low and high
    percent of the positive's."""
    rows = stored(prepared(df, anchors, id_col, label_col, vector_col), "mined-vectors")
    held = rows.agg(F.coalesce(F.sum(F.size("q").cast("long") + 1), F.lit(0)).alias("n")).first()
    parts = max(-(-held.n // PART_NUMBERS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asks = rows.where("anchor").withColumn("limits", F.lit(None).cast(LIMITS))
    near = _first(_by_parts(rows, asks, parts, _positives(positives), POSITIVES), ["anchor_row"], "score", "vec_id", positives)
    limits = near.groupBy("anchor_row").agg(F.collect_list(F.struct("row", "vec_id", "score")).alias("limits"))  # at most `positives` each
    limits = stored(limits.withColumnRenamed("anchor_row", "row"), "mined-positives")
    asks = rows.where("anchor").join(limits, "row")
    found = _by_parts(rows, asks, parts, _negatives(negatives, low, high), NEGATIVES)
    return _first(found, ["anchor_row", "positive_row"], "negative_score", "negative_id", negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
