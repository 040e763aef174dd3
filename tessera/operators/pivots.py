"""Exact neighbours and reach in a metric space by a pivot index: what the triangle inequality excludes is not compared.

Every vector is described by its distances to a bounded number of pivots. Vectors are put in order of (nearest pivot, distance to
it) and cut into parts of equal numbers of rows; of a part the least and largest distance to each pivot are known. A query at
distance d of a pivot is at least max(d - largest, least - d) away from every member of the part. So a query first looks into
the part that may be closest, which bounds how far it has to look, and then only into parts that may be closer than that. Within a
part, members are screened by one product in single precision (`screens`), which knows how far the query has to look.

All work is in tasks that hold one part at a time; a block of queries streams past the part. Parts' bounds are sent to the executors in
blocks of at most BOUND_NUMBERS numbers. Where vectors have no clusters, little is excluded, and the results are the same.
Each result says how many pairs were compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.common import laid_out, running_number
from tessera.operators.screens import ROWS, STRIDE, Screen, blocks_of, distances, matrix, meet

PIVOTS = 32
PART_ROWS = ROWS
BOUND_NUMBERS = 8_000_000
#: Bounds allow for rounding.
SLACK = 1e-9


@dataclass
class Index:
    """rows: part, side, id, v, to (distances to the pivots), limit (squared radius, or null); bounds: part, side, n, least, largest, limit, first (smallest id).
    A part has rows of one side."""

    rows: DataFrame
    bounds: DataFrame
    pivots: np.ndarray


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.reshape(-1)))


def _described(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """id, v, limit, side of df, with to, home (nearest pivot) and away (distance to it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                to = np.sqrt(distances(matrix(b.column(1)), pivots))
                home = to.argmin(1)
                yield pa.RecordBatch.from_arrays([*b.columns, _lists(to), pa.array(home.astype(np.int32)), pa.array(to[np.arange(len(to)), home])], names=["id", "v", "limit", "side", "to", "home", "away"])

    return df.select("id", "v", "limit", "side").mapInArrow(run, "id long, v array<double>, limit double, side int, to array<double>, home int, away double")


def index(df: DataFrame, key: str, vector: str, limit: str | None = None, pivots: int = PIVOTS, part_rows: int = PART_ROWS, side: Column | None = None) -> Index:
    """An index of the rows of df whose vector is not null. Pivots are the vectors of the first keys in the order of a hash.
    side: few small numbers from 0 on, by which the rows are told apart (none: all are of side 0; a row whose side is null is left out)."""
    limits = (F.col(limit) if limit else F.lit(None)).cast("double")
    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), limits.alias("limit"), (F.lit(0) if side is None else side).cast("int").alias("side")).where("side is not null")
    at = [r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(pivots).select("v").collect()]
    held = np.array(at, float) if at else np.zeros((0, 0))
    if not at:
        return Index(rows.selectExpr("0L AS part", "side", "id", "v", "v AS to", "limit"), rows.selectExpr("0L AS part", "side", "0L AS n", "v AS least", "v AS largest", "limit", "id AS first"), held)
    placed = running_number(_described(rows, held), ["side", "home", "away", "id"], "place")
    # where a side ends within a part, the next begins one of its own
    placed = laid_out(placed.select((F.floor(F.col("place") / part_rows) + F.col("side")).cast("long").alias("part"), "side", "id", "v", "to", "limit"))
    of = [(f(F.col("to")[k]).alias(f"{name}{k}")) for name, f in (("a", F.min), ("b", F.max)) for k in range(len(at))]
    ends = placed.groupBy("part").agg(F.first("side").alias("side"), F.count("*").alias("n"), F.max("limit").alias("limit"), F.min("id").alias("first"), *of)
    least, largest = (F.array(*[F.col(f"{name}{k}") for k in range(len(at))]).alias(word) for name, word in (("a", "least"), ("b", "largest")))
    return Index(placed, laid_out(ends.select("part", "side", "n", "limit", "first", least, largest)), held)


def limited(ix: Index, limits: DataFrame, key: str, limit: str) -> Index:
    """The index of those of its rows that have a limit, with their limits."""
    rows = laid_out(ix.rows.drop("limit").join(limits.select(F.col(key).alias("id"), F.col(limit).cast("double").alias("limit")), "id"))
    return Index(rows, laid_out(ix.bounds.drop("limit").join(rows.groupBy("part").agg(F.max("limit").alias("limit")), "part")), ix.pivots)


@dataclass
class Bounds:
    part: np.ndarray
    side: np.ndarray
    n: np.ndarray
    limit: np.ndarray
    least: np.ndarray
    largest: np.ndarray
    first: np.ndarray

    def below(self, to: np.ndarray) -> np.ndarray:
        """The least possible distance of a query to each part."""
        return np.maximum(np.maximum(to - self.largest, self.least - to).max(1) - SLACK, 0)

    def open_to(self, side: int | None, across: bool) -> np.ndarray:
        """The parts that a query of this side (null: of none) may look into: those of its side, or of all others."""
        return np.full(len(self.part), True) if side is None else (self.side != side) == across


def _blocks(ix: Index) -> Iterator:
    """The bounds of all parts, sent in blocks."""
    per, spark = max(1, BOUND_NUMBERS // max(1, 2 * len(ix.pivots))), ix.rows.sparkSession
    last = ix.bounds.agg(F.max("part")).first()[0]
    for at in range(0, -1 if last is None else last + 1, per):
        found = ix.bounds.where((F.col("part") >= at) & (F.col("part") < at + per)).orderBy("part").collect()  # at most `per` parts
        yield spark.sparkContext.broadcast(Bounds(np.array([r.part for r in found]), np.array([r.side for r in found]), np.array([r.n for r in found]), np.array([r["limit"] if r["limit"] is not None else np.nan for r in found]), np.array([r.least for r in found]), np.array([r.largest for r in found]), np.array([r["first"] for r in found])))


def _ask(queries: DataFrame, ix: Index, choose: Callable, schema: str) -> DataFrame:
    """What choose(bounds, a query's row) gives, over all blocks of bounds."""
    out = None
    for sent in _blocks(ix):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            fields = [f.split() for f in schema.split(", ")]
            kinds = {"long": pa.int64(), "double": pa.float64()}
            for b in batches:
                rows = [x for r in b.to_pylist() for x in choose(sent.value, r)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], names=[n for n, _ in fields])

        one = queries.mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return out


def _visits(ix: Index, asks: DataFrame, look: Callable, schema: str, blocks: int) -> DataFrame:
    """look(the part's rows, a batch of asks) for each part that is asked. asks: part, query, v, bound (a squared distance), slope.
    A part that many ask is sent to several tasks, each with a block of the queries."""
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int").alias("block")
    cells = asks.select("part", block("query")).distinct()
    rows = ix.rows.select("part", "id", "v", "limit").join(cells, "part")
    sent = asks.select("part", block("query"), F.col("query").alias("id"), "v", "bound", "slope")
    return meet(rows, sent, Screen, look, schema, blocks)


NEAR = "query long, id long, measure double, compared long"


def _nearest_of(k: int) -> Callable:
    def look(part: Screen, names: np.ndarray, v: np.ndarray, bound: np.ndarray, slope: np.ndarray) -> pa.RecordBatch:
        at, ids, far = part.nearest(names, v, k, bound)
        # a row without an id carries how many pairs were compared
        none = pa.nulls(len(names), pa.int64())
        counts = np.concatenate([np.zeros(len(at), np.int64), np.full(len(names), len(part.ids))])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([names[at], names])), pa.concat_arrays([pa.array(ids), none]), pa.concat_arrays([pa.array(far), pa.nulls(len(names), pa.float64())]), pa.array(counts)], names=["query", "id", "measure", "compared"])

    return look


def _queries(df: DataFrame, key: str, vector: str, ix: Index) -> DataFrame:
    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.lit(None).cast("double").alias("limit"), F.lit(None).cast("int").alias("side"))
    return laid_out(_described(rows, ix.pivots).select(F.col("id").alias("query"), "v", "to", "side"))


def _of(ix: Index) -> DataFrame:
    """The index's own rows as queries; home is the part that holds the row."""
    return ix.rows.select(F.col("id").alias("query"), "v", "to", "side", F.col("part").alias("home"))


def _blocks_for(queries: DataFrame, ix: Index) -> int:
    """Blocks of the queries of the largest side."""
    most = queries.groupBy("side").count().agg(F.max("count")).first()[0]
    return blocks_of(most or 0, ix.bounds.count(), queries.sparkSession.sparkContext.defaultParallelism)


def _first_look(at_home: DataFrame) -> DataFrame:
    """Each query in its home part, with nothing known."""
    return at_home.select(F.col("home").alias("part"), "query", "v", F.lit(None).cast("double").alias("bound"), F.lit(0.0).alias("slope"))


def _first_part(bounds: Bounds, r: dict, across: bool) -> list[tuple]:
    low, its = bounds.below(np.array(r["to"])), bounds.open_to(r["side"], across)
    k = int(np.lexsort((bounds.part, bounds.largest.mean(1), low, ~its))[0])
    return [(r["query"], int(bounds.part[k]), float(low[k]))] if its[k] else []


def _homes(queries: DataFrame, ix: Index, across: bool = False) -> DataFrame:
    """query, home: the part that may be closest, of those that are open to the query."""
    found = _ask(queries.select("query", "to", "side"), ix, partial(_first_part, across=across), "query long, part long, low double")
    return found.groupBy("query").agg(F.min_by("part", F.struct("low", "part")).alias("home"))


def _no_rows(queries: DataFrame, schema: str) -> DataFrame:
    return queries.sparkSession.createDataFrame([], schema)


def nearest(ix: Index, df: DataFrame | None, key: str, vector: str, k: int) -> tuple[DataFrame, DataFrame]:
    """query, id, measure (squared distance), rank of the k nearest rows of each query but those with its id, ties by id; and the
    pairs compared, by query. A query that meets fewer rows than k has fewer neighbours. Without df the index's rows ask, each on its side."""
    if not len(ix.pivots):
        return _no_rows(ix.rows, "query long, id long, measure double, rank long"), _no_rows(ix.rows, "query long, compared long")
    if df is None:
        at_home = _of(ix)
    else:
        queries = _queries(df, key, vector, ix)
        at_home = laid_out(queries.join(_homes(queries, ix), "query"))
    blocks = _blocks_for(at_home, ix)
    looked = laid_out(_visits(ix, _first_look(at_home), _nearest_of(k), NEAR, blocks))
    found = looked.where("id is not null")
    last = F.max(F.struct("measure", "id"))
    bound = found.groupBy("query").agg(F.count("*").alias("n"), last.alias("last")).where(F.col("n") >= k).select("query", F.col("last.measure").alias("bound"), F.col("last.id").alias("last"))
    asked = at_home.join(bound, "query", "left")

    def closer(bounds: Bounds, r: dict) -> list[tuple]:
        far = np.inf if r["bound"] is None else np.sqrt(r["bound"]) + SLACK
        near = (bounds.below(np.array(r["to"])) <= far) & bounds.open_to(r["side"], False)
        if r["bound"] == 0:  # none is closer than copies: only smaller ids count, so copies do not all meet
            near &= bounds.first < r["last"]
        return [(r["query"], int(p)) for p in bounds.part[near] if p != r["home"]]

    visits = laid_out(_ask(asked.select("query", "to", "side", "home", "bound", "last"), ix, closer, "query long, part long"))
    more = laid_out(_visits(ix, visits.join(asked.select("query", "v", "bound", F.lit(0.0).alias("slope")), "query"), _nearest_of(k), NEAR, blocks))
    both = looked.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("measure", "id")).cast("long")
    near = both.where("id is not null").select("query", "id", "measure").withColumn("rank", rank).where(F.col("rank") <= k)
    return near, both.groupBy("query").agg(F.sum("compared").alias("compared"))


REACH = "query long, hit boolean, realism double, compared long"
#: Added to squared distances in a realism.
EPSILON, TOLERANCE = 1e-6, 1e-12


def _real(d: np.ndarray, limit: np.ndarray) -> np.ndarray:
    return np.nanmax(np.where(np.isfinite(d), limit / (d + EPSILON), 0), axis=1, initial=0)


def _reached(part: Screen, names: np.ndarray, v: np.ndarray, bound: np.ndarray, slope: np.ndarray) -> pa.RecordBatch:
    hit, real = np.zeros(len(names), bool), np.zeros(len(names))
    if not np.isfinite(bound).all():  # nothing known: what some rows reach, the others have to exceed
        d, limit = part.measured(v, STRIDE), part.limit[::STRIDE]
        hit, real = (d <= limit + TOLERANCE).any(1), _real(d, limit)
        with np.errstate(divide="ignore"):
            bound, slope = np.full(len(names), TOLERANCE), np.maximum(np.where(real > 0, 1 / real, np.inf), np.where(hit, 0.0, 1.0))
    left = part.within(v, bound, slope)
    if left is None:
        d = part.measured(v)
        hit, real = (d <= part.limit + TOLERANCE).any(1), _real(d, part.limit)
    else:
        at, row = left
        d, limit = part.pairs(v, at, row), part.limit[row]
        hit[at[d <= limit + TOLERANCE]] = True
        np.fmax.at(real, at, np.where(np.isfinite(d), limit / (d + EPSILON), 0))
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array(hit), pa.array(real), pa.array(np.full(len(names), len(part.ids)))], names=["query", "hit", "realism", "compared"])


def within(ix: Index, df: DataFrame | None, key: str, vector: str, own: Index | None = None) -> DataFrame:
    """query, hit (does it lie within the limit of any row), realism (largest limit / (squared distance + EPSILON)), compared.

    Without df the rows of own ask, each of the rows of all other sides; one without such rows is left out.
    A part is looked into if one of its limits may reach the query, or a realism in it may be above the one found at home.
    """
    if not len(ix.pivots):
        return _no_rows(ix.rows, REACH)
    queries = _queries(df, key, vector, ix) if own is None else _of(own).drop("home")
    at_home, blocks = laid_out(queries.join(_homes(queries, ix, True), "query")), _blocks_for(queries, ix)
    looked = laid_out(_visits(ix, _first_look(at_home), _reached, REACH, blocks))
    asked = at_home.join(looked.select("query", "hit", "realism"), "query")

    def may_reach(bounds: Bounds, r: dict) -> list[tuple]:
        low = bounds.below(np.array(r["to"])) ** 2
        wanted = np.nan_to_num(bounds.limit / (low + EPSILON), nan=0.0) > r["realism"]
        if not r["hit"]:
            wanted |= low <= bounds.limit + TOLERANCE
        wanted &= bounds.open_to(r["side"], True)
        return [(r["query"], int(p)) for p in bounds.part[wanted] if p != r["home"]]

    visits = laid_out(_ask(asked.select("query", "to", "side", "home", "hit", "realism"), ix, may_reach, "query long, part long"))
    # a member counts if its limit reaches the query, or for a realism above the one found: at most slope times its limit away
    slope = F.greatest(F.when(F.col("realism") > 0, 1 / F.col("realism")).otherwise(float("inf")), F.when(F.col("hit"), 0.0).otherwise(1.0)).alias("slope")
    asks = visits.join(asked.select("query", "v", F.lit(TOLERANCE).alias("bound"), slope), "query")
    more = _visits(ix, asks, _reached, REACH, blocks)
    return looked.unionByName(more).groupBy("query").agg(F.bool_or("hit").alias("hit"), F.max("realism").alias("realism"), F.sum("compared").alias("compared"))
